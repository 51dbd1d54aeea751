"""Scores of texts by a hidden Markov language model, with Baum-Welch counts summed over partitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import arrow_rows, bounded, cut, drop, pick, slices
from corpuslab.llm.language_id import held_out

#: Latent states; word classes (0 is the end of a text); folds of the hold-out.
STATES, CLASSES, FOLDS = 5, 8192, 10
#: Passes of Baum-Welch, all of them over all training texts: those from the rough start, and those after them.
SEED_ROUNDS, ROUNDS = 12, 2
#: Not read: no pass takes a sample. The name stays for callers that set it.
SEED_DOCS = None
ALPHA = 0.1
#: Text bytes of a block whose words are looked up together, and the least number of blocks.
BLOCK_BYTES, LEAST_BLOCKS = 16 << 20, 64
#: Bytes of stored classes (two a token) that a task of a pass handles at once.
SEQUENCE_BYTES = 1 << 20
#: Tokens of a segment; segments are run side by side.
SEGMENT = 128


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_classes(raw: bytes) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """Where the words of raw start, their classes, and the words: runs of bytes other than space and U+0009 to U+000D.

    A class is a rule, not a table, so no pass needs the vocabulary: a hash of a word's last four bytes, or of
    all of a shorter word and a mark of its start."""
    b = np.frombuffer(raw + b" ", np.uint8)
    space = _SPACE[b]
    last = np.flatnonzero(~space[:-1] & space[1:])
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    size = last - start
    code = b[last].astype(np.uint32)
    for k in range(1, 4):
        code |= np.where(size >= k, b[np.maximum(last - k, 0)], np.where(size == k - 1, 94, 0)).astype(np.uint32) << np.uint32(8 * k)
    mixed = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    ends = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(b[~space])])
    return start, (mixed % np.uint64(CLASSES - 1)).astype(np.int32) + 1, words


def with_ends(values: np.ndarray, size: np.ndarray, end) -> np.ndarray:
    """Values of the words of all texts, with that of the end behind each text's."""
    return np.insert(values, np.cumsum(size - 1), end)


def class_sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """The classes of all tokens, each text's words (A-Z in lower case) and then its end (0), the tokens of each text, and the words."""
    raw = [t.encode().lower() if t else b"" for t in texts]
    start, classes, words = word_classes(b" ".join(raw))
    border = np.cumsum([0, *(len(x) + 1 for x in raw)])
    size = np.diff(np.searchsorted(start, border)) + 1
    return with_ends(classes, size, 0), size, words


def _active(length: np.ndarray) -> tuple[int, list[int]]:
    """The steps of segments, longest first, and how many of them are longer than t, for each t to the last step."""
    steps = int(length[0]) if len(length) else 0
    return steps, np.searchsorted(-length, -np.arange(steps + 1), "left").tolist()


@dataclass
class Hmm:
    start: np.ndarray  # STATES
    move: np.ndarray  # STATES x STATES
    emit: np.ndarray  # STATES x CLASSES

    @staticmethod
    def rough(background: np.ndarray) -> Hmm:
        """A start that breaks the symmetry of states: sticky moves, perturbed emissions."""
        rng = np.random.default_rng(5)
        emit = (background + 1e-6) * rng.uniform(0.2, 1.8, (STATES, CLASSES))
        return Hmm(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.02 / STATES) + 0.98 * np.eye(STATES), emit / emit.sum(1, keepdims=True))

    def run(self, obs: np.ndarray, size: np.ndarray, learn: bool) -> tuple[np.ndarray, list[np.ndarray] | None]:
        """Natural log likelihood of each sequence, and if asked for the expected counts [start, move, emit].

        Scaled forward (and backward) recursion, exact for sequences of any length: sequences are cut into
        segments, which are run side by side. Where a sequence has several, the product of the step matrices
        of each is taken first and the products are chained along the sequence, so that all segments are run
        from their known ends. Forward and backward share their scales, so that a state's probability given
        the whole sequence is the product of the two.
        """
        s, docs = STATES, len(size)
        first = np.cumsum(size) - size
        parts = -(-size // SEGMENT)
        base = np.cumsum(parts) - parts
        seg_doc = np.repeat(np.arange(docs), parts)
        seg_no = np.arange(parts.sum()) - np.repeat(base, parts)
        seg_len = np.minimum(SEGMENT, size[seg_doc] - seg_no * SEGMENT)
        order = np.argsort(-seg_len, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        length, heads, several = seg_len[order], seg_no[order] == 0, parts[seg_doc[order]] > 1
        at = (first[seg_doc] + seg_no * SEGMENT)[order]
        before, after, likelihood = np.repeat(self.start[:, None], len(at), 1), np.ones((s, len(at))), np.zeros(docs)
        chained = np.flatnonzero(several)
        if len(chained):
            self._chain(obs, at[chained], length[chained], heads[chained], parts, base, np.searchsorted(chained, place), chained, before, after, likelihood, learn)
        # what is left is run inside the segments: if only the likelihood is asked for, those that are a sequence
        inside = np.arange(len(at)) if learn else np.flatnonzero(~several)
        at, length, heads, alone, before, after = at[inside], length[inside], heads[inside], ~several[inside], before[:, inside], after[:, inside]
        steps, active = _active(length)
        move, scale, held = self.move, np.zeros(len(at)), np.ones(len(at))
        ends = np.cumsum([0, *active[:steps]]).tolist()
        o = np.concatenate([obs[at[: active[t]] + t] for t in range(steps)], dtype=np.intp) if steps else np.zeros(0, np.intp)
        forward, seen = np.empty((s, len(o) if learn else 0)), []
        now = before
        for t in range(steps):
            n = active[t]
            x = np.take(self.emit, o[ends[t] : ends[t + 1]], axis=1)
            moved = np.matmul(move.T, now[:, :n], out=forward[:, ends[t] : ends[t + 1]] if learn else None)
            if not t:
                moved[:, heads] = now[:, heads]
            moved *= x
            total = moved.sum(0)
            held[:n] *= total
            if t % 8 == 7:
                scale += np.log(held)
                held.fill(1.0)
            np.reciprocal(total, out=total)
            moved *= total
            if learn:
                x *= total
                seen.append(x)
            now = moved
        likelihood[seg_doc[order][inside[alone]]] = (scale + np.log(held))[alone]
        if not learn:
            return likelihood, None
        moves, starts, emits = np.zeros((s, s)), np.zeros(s), np.zeros((s, CLASSES))
        now, inner = after, ~heads
        for t in range(steps - 1, -1, -1):
            n, ended = active[t], active[t + 1]
            state = forward[:, ends[t] : ends[t + 1]]  # becomes the probability of each state given the whole sequence
            if ended < n:  # segments that end here: what follows them gets the scale of their own recursion
                now[:, ended:n] /= (state[:, ended:] * now[:, ended:n]).sum(0)
            ahead = seen.pop()
            ahead *= now[:, :n]
            state *= now[:, :n]
            if t:
                moves += forward[:, ends[t - 1] : ends[t - 1] + n] @ ahead.T
                np.matmul(move, ahead, out=now[:, :n])
            else:
                starts = state[:, heads].sum(1)
                moves += before[:, inner] @ ahead[:, inner].T
        if steps:
            emits = np.stack([np.bincount(o, x, CLASSES) for x in forward])
        return likelihood, [starts, self.move * moves, emits]

    def _chain(self, obs, at, length, heads, parts, base, place, chained, before, after, likelihood, learn: bool) -> None:
        """Fills in what is before and after each segment (columns `chained`) of the sequences that have several, and their likelihood."""
        s, move = STATES, self.move
        steps, active = _active(length)
        # products of the steps of each segment: state at its end, state before it; states come first in all arrays, segments last
        product = np.repeat(move.T[:, :, None], len(at), 2)
        product[:, :, heads] = np.eye(s)[:, :, None]
        scale = np.zeros(len(at))
        some = product
        for t in range(steps):
            n = active[t]
            if n < some.shape[2]:  # shorter segments are done
                product[:, :, n : some.shape[2]] = some[:, :, n:]
                some = np.ascontiguousarray(some[:, :, :n])
            if t:
                some = (move.T @ some.reshape(s, s * n)).reshape(s, s, n)
            some *= np.take(self.emit, obs[at[:n] + t], axis=1)[:, None, :]
            if t % 4 == 3:
                total = some.sum((0, 1))
                some /= total
                scale[:n] += np.log(total)
        product[:, :, : some.shape[2]] = some
        total = product.sum((0, 1))
        product, scale = product / total, scale + np.log(total)
        # along each sequence, all sequences at once
        vector = np.repeat(self.start[:, None], len(parts), 1)
        for k in range(int(parts.max())):
            live = np.flatnonzero((parts > k) & (parts > 1))
            seg = place[base[live] + k]
            before[:, chained[seg]] = vector[:, live]
            new = np.einsum("in,jin->jn", vector[:, live], product[:, :, seg])
            total = new.sum(0)
            vector[:, live] = new / total
            likelihood[live] += np.log(total) + scale[seg]
        if not learn:
            return
        back = np.ones((s, len(parts)))
        for k in range(int(parts.max()) - 1, -1, -1):
            live = np.flatnonzero((parts > k) & (parts > 1))
            seg = place[base[live] + k]
            after[:, chained[seg]] = back[:, live]
            new = np.einsum("jin,jn->in", product[:, :, seg], back[:, live])
            back[:, live] = new / new.sum(0)

    @staticmethod
    def of(counts: list[np.ndarray]) -> Hmm:
        """The maximisation step, with a little smoothing so that no class is impossible."""
        start, move, emit = counts
        overall = emit.sum(0) + ALPHA
        overall /= overall.sum()
        emit = emit + overall * STATES * 10
        move, start = move + 0.1, start + 0.1
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _packed(schema: pa.Schema, arrays: list[np.ndarray]) -> pa.RecordBatch:
    rows = [(kind, i, r) for kind, a in enumerate(arrays) for i, r in enumerate(np.atleast_2d(a))]
    return arrow_rows(schema, kind=[r[0] for r in rows], row=[r[1] for r in rows], x=[r[2].tolist() for r in rows])


def _unpacked(rows) -> list[np.ndarray] | None:
    out = [np.zeros((1, STATES)), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))]
    for r in rows:
        out[r["kind"]][r["row"]] = r["x"]
    return [out[0][0], out[1], out[2]] if rows else None


def sequences(texts: DataFrame) -> DataFrame:
    """One row a row of `texts` (text): obs, the classes of its tokens, two bytes each. Each pass reads them again."""
    schema = pa.schema([("obs", pa.binary())])

    def encode(batches):
        for b in slices(batches, "text"):
            obs, size, _ = class_sequences(b.column(0).to_pylist())
            raw, last = obs.astype("<u2").tobytes(), np.cumsum(2 * size).tolist()
            yield arrow_rows(schema, obs=[raw[i:j] for i, j in zip([0, *last], last, strict=False)])

    return texts.select("text").mapInArrow(encode, "obs binary")


def expected_counts(rows: DataFrame, hmm: Hmm) -> list[np.ndarray] | None:
    """The expected counts of all rows of sequences() under hmm, summed over partitions; None without rows.

    The driver gets sums of fixed size (STATES x CLASSES), whatever the corpus."""
    sent = rows.sparkSession.sparkContext.broadcast((hmm.start, hmm.move, hmm.emit))
    schema = pa.schema([("kind", pa.int32()), ("row", pa.int32()), ("x", pa.list_(pa.float64()))])

    def expect(batches):
        now, total = Hmm(*sent.value), None
        for b in slices(batches, "obs", SEQUENCE_BYTES):
            raw = b.column(0).to_pylist()
            obs, size = np.frombuffer(b"".join(raw), "<u2").astype(np.int32), np.fromiter(map(len, raw), np.int64, len(raw)) // 2
            counts = now.run(obs, size, True)[1]
            total = counts if total is None else [x + y for x, y in zip(total, counts, strict=True)]
        if total is not None:
            yield _packed(schema, total)

    parts = rows.mapInArrow(expect, "kind int, row int, x array<double>").select("kind", "row", F.posexplode("x").alias("i", "v"))
    sums = parts.groupBy("kind", "row", "i").agg(F.sum("v").alias("v")).groupBy("kind", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda z: z.v).alias("x"))
    return _unpacked(sums.collect())


def train(texts: DataFrame, background: np.ndarray) -> Hmm:
    """Baum-Welch: SEED_ROUNDS + ROUNDS passes over all rows of `texts` (text), none over a sample.

    background: the counts of the classes in all training texts, from which the first pass starts."""
    hmm = Hmm.rough(background / max(1, background.sum()))
    rows = cut(sequences(texts), "lm-sequences")
    for _ in range(SEED_ROUNDS + ROUNDS):
        counts = expected_counts(rows, hmm)
        if counts is None:  # no training texts
            break
        hmm = Hmm.of(counts)
    drop(rows)
    return hmm


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    A token's probability in a state is that of its class in the state times that of the word in its class,
    (c + 0.1) / (N_class + 0.1 * (V_class + 1)); c, N and V are exact counts of all training texts. Words are
    looked up in blocks of documents: each block asks for its distinct words once, and gets their counts
    back by a join, so no task or broadcast holds the vocabulary.

    Null and empty texts are one end token. Rows without an id are not held out and are learned from.
    Repeated rows count each time. An empty table gives an empty result; without training texts (N = 0)
    every token is unknown.
    """
    spark = docs.sparkSession
    bounded(spark)
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", held_out(F.col("doc_id"), folds))
    rows, size = base.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(LEAST_BLOCKS, -(-(size or 0) // BLOCK_BYTES))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    asked = cut(dealt.groupBy("block").applyInArrow(_asked, "block int, word binary, class int, n long"), "lm-words")
    counts = cut(asked.groupBy("word", "class").agg(F.sum("n").alias("c")), "lm-counts")
    by_class = counts.filter("c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # CLASSES rows at most
    ends = rows - (base.filter("held_out").count() if rows else 0)
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        n_class[r["class"]], v_class[r["class"]] = r["n"], r["v"]
    total = int(n_class.sum()) + ends
    vocabulary = int(v_class.sum()) + (ends > 0)

    training = base.filter("not held_out")
    background = n_class.copy()
    background[0] = ends
    hmm = train(training, background)
    sent = spark.sparkContext.broadcast((hmm.start, hmm.move, hmm.emit, n_class, v_class))
    answered = asked.select("block", "word").join(counts.select("word", "c"), "word").select("block", "word", "c")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scored(left, right, sent.value, total, vocabulary, ends)

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, ddl)


def _asked(block: pa.Table) -> pa.Table:
    """The distinct words of a block's documents and how often each is in training texts."""
    words, classes, training = [], [], []
    for b in slices(iter(block.combine_chunks().to_batches()), "text"):
        obs, size, some = class_sequences(b.column(1).to_pylist())
        words.append(some)
        classes.append(np.delete(obs, np.cumsum(size) - 1))
        training.append(np.repeat(~np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool), size - 1))
    coded = pa.chunked_array(words, pa.binary()).dictionary_encode().chunks  # one dictionary for all
    dictionary = coded[0].dictionary if coded else pa.array([], pa.binary())
    kinds = len(dictionary)
    class_of, n = np.zeros(kinds, np.int32), np.zeros(kinds, np.int64)
    if kinds:
        at = np.concatenate([np.asarray(x.indices) for x in coded])
        class_of[at] = np.concatenate(classes)
        n = np.bincount(at[np.concatenate(training)], minlength=kinds)
    number = block["block"][0].as_py() if block.num_rows else 0
    return pa.table({"block": pa.array(np.full(kinds, number, np.int32)), "word": dictionary, "class": pa.array(class_of), "n": pa.array(n.astype(np.int64))})


def _scored(docs: pa.Table, known: pa.Table, model, total: int, vocabulary: int, ends: int) -> pa.Table:
    start, move, emit, n_class, v_class = model
    hmm = Hmm(start, move, emit)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    if not docs.num_rows:  # the empty side of a cogroup has no columns
        return schema.empty_table()
    cuts = list(slices(iter(docs.combine_chunks().to_batches()), "text"))
    read = [class_sequences(b.column(1).to_pylist()) for b in cuts]
    words = pa.chunked_array([x for _, _, x in read], pa.binary())
    count_of, places = np.zeros(0), np.zeros(0, np.int64)
    if known.num_rows:
        count_of = np.asarray(known["c"]).astype(np.float64)
        found = pc.index_in(words, value_set=known["word"].combine_chunks())
        if found.null_count:
            raise KeyError("a word of the block has no count")
        places = np.asarray(found)
    borders = np.cumsum([0, *(len(x) for _, _, x in read)]).tolist()
    out = []
    for b, (obs, size, _), i, j in zip(cuts, read, borders, borders[1:], strict=False):
        c = with_ends(count_of[places[i:j]], size, ends)
        last = np.cumsum(size) - 1
        first = last + 1 - size
        unigram = np.log10((c + ALPHA) / (total + ALPHA * (vocabulary + 1)))
        in_class = np.log10((c + ALPHA) / (n_class[obs] + ALPHA * (v_class[obs] + 1)))
        in_class[last] = 0.0  # the end is the only token of its class
        likelihood, _ = hmm.run(obs, size, False)
        out.append(arrow_rows(schema, doc_id=b.column(0), held_out=b.column(2), n_tokens=size.tolist(), n_known=np.add.reduceat((c > 0).astype(np.int64), first).tolist(), train_tokens=[total] * len(size), base_score=np.add.reduceat(unigram, first).tolist(), score=(likelihood / np.log(10) + np.add.reduceat(in_class, first)).tolist()))
    return pa.Table.from_batches(out, schema)
