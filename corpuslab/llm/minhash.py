"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures, with links confirmed on whole shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import arrow_rows, bounded, cut, drop, pick, salted_join, slices, turn, without

#: A signature has CHUNKS * WIDTH symbols of 16 bits. Signatures that differ in DISTANCE symbols at most have, by the
#: pigeonhole principle, a chunk with DISTANCE // CHUNKS = 1 differing symbol at most: they share a chunk with that
#: symbol masked. Two sets of similarity 0.8 differ in 13 of 65 symbols on average (deviation 3.2), so 26 is four
#: deviations beyond.
CHUNKS, WIDTH, DISTANCE = 13, 5, 25
SYMBOLS = CHUNKS * WIDTH
#: Rows of a bucket that are compared in one tile with as many others, and about the rows of tiles that a task gets.
TILE, TASK_ROWS = 1024, 4096
#: Bytes of shingle sets that one side of a tile holds (one set at least).
TILE_BYTES = 24 << 20

#: Text bytes whose words are hashed at once.
SLICE = 1 << 20

_rng = np.random.default_rng(11)
_A = _rng.integers(1, 1 << 63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = _rng.integers(0, 1 << 63, 256, np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _POWERS = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)]), dtype=np.uint64) for p in (_BASE, _INVERSE))
    return _POWERS


def _forget() -> None:
    global _POWERS
    _POWERS = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of raw start, and a hash (64 bits) of each: differences of one running polynomial sum."""
    b = np.frombuffer(raw + b" ", np.uint8)
    space = _SPACE[b]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space[:-1] & space[1:])
    power, inverse = _power(len(b))
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * power[: len(b)], dtype=np.uint64)])
        return start, _mix((run[last + 1] - run[start]) * inverse[start] + (last - start).astype(np.uint64))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes (64 bits) of each text's shingles.

    Words are runs of characters other than space and U+0009 to U+000D, with A-Z in lower case. A text of
    fewer words than a shingle has its whole sequence as one; a text without words has none.
    """
    raw = [t.encode().lower() if t else b"" for t in texts]
    start, words = word_hashes(b" ".join(raw))
    border = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in raw)])).tolist()
    with np.errstate(over="ignore"):

        def shingles(h: np.ndarray, n: int) -> np.ndarray:
            out = np.full(max(0, len(h) - n + 1), n, np.uint64)
            for j in range(n):
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
            return out

        whole = shingles(words, size) if len(words) >= size else words[:0]
        return [np.unique(whole[a : b - size + 1]) if b - a >= size else shingles(words[a:b], b - a) if b > a else words[:0] for a, b in zip(border, border[1:], strict=False)]


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A mixed minimum for each of the permutations."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            low = np.minimum(low, (shingles[i : i + 2048, None] * a + b).min(0))
        return _mix(low)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols of 16 bits: what the index is made of."""
    return (_minima(shingles, _A, _B) & np.uint64(0xFFFF)).astype("<u2")


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """rows x (CHUNKS * WIDTH) keys: each chunk with each one of its symbols masked."""
    parts = signatures.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(parts), CHUNKS, WIDTH), np.uint64)
    place = np.arange(CHUNKS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for masked in range(WIDTH):
            h = np.broadcast_to(_mix(place * np.uint64(WIDTH) + np.uint64(masked + 1)), parts.shape[:2])
            for j in range(WIDTH):
                if j != masked:
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
            out[:, :, masked] = h
    return out.reshape(len(parts), -1).view(np.int64)


def _signed(batches, size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h", pa.binary()), ("sig", pa.binary()), ("text_md5", pa.string())])
    turn("near dedup", _forget)
    for b in slices(batches, "text", SLICE):
        texts = b.column(1).to_pylist()
        sets = shingle_sets(texts, size)
        md5 = [hashlib.md5((t or "").encode(), usedforsecurity=False).hexdigest() for t in texts]
        yield arrow_rows(schema, doc_id=b.column(0), n=[len(s) for s in sets], h=[_name(s) for s in sets], sig=[signature(s).tobytes() for s in sets], text_md5=md5)


def _name(shingles: np.ndarray) -> bytes:
    """What tells a set of shingles from others (128 bits)."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _keyed(batches):
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            b = batch.slice(i, 2000)
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u2").reshape(-1, SYMBOLS)
            keys = chunk_keys(sig)
            per = keys.shape[1]
            yield arrow_rows(schema, key=pa.array(keys.reshape(-1)), rep=pa.array(np.repeat(np.asarray(b.column(0)), per)), n=pa.array(np.repeat(np.asarray(b.column(1)), per)))


def _similar(n_a, n_b, shared, percent: int):
    return 100 * shared >= percent * (n_a + n_b - shared)


def _near(batches):
    """Pairs whose signatures are within the distance."""
    for b in batches:
        if b.num_rows:
            a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, SYMBOLS) for i in (2, 3))
            near = (a != c).sum(1) <= DISTANCE
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near))


def _confirm(batches, percent: int):
    """Pairs whose whole sets are similar enough."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            b = batch.slice(i, 500)
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                keep.append(bool(_similar(len(p), len(q), int((q[at] == p).sum()), percent)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _foreign(t: pa.Table, sig: np.ndarray, percent: int):
    """(i, others) of a tile: rows of other components within the signature distance and the ratio of sizes, each pair once.

    A pair has a row outside the tile's largest component, so only those rows are walked."""
    n, comp, side = np.asarray(t["n"]), np.asarray(t["comp"]), np.asarray(t["side"])
    names, sizes = np.unique(comp, return_counts=True)
    minor = comp != names[sizes.argmax()]
    place = np.arange(len(n))
    for i in np.flatnonzero(minor).tolist():
        # a tile off the diagonal compares its two sides (0 and 1), one on it (2) its rows with each other
        with_i = (side == 1 - side[i]) if side[i] < 2 else (place != i)
        other = np.flatnonzero(with_i & (comp != comp[i]) & (~minor | (place > i)) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        if len(other):
            other = other[(sig[other] != sig[i]).sum(1) <= DISTANCE]
            if len(other):
                yield i, other


def _symbols(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(-1, SYMBOLS)


def _offered(t: pa.Table, sig: np.ndarray, percent: int):
    """_foreign(), where two rows that share several keys are looked at under the first of them only."""
    keys, key = chunk_keys(sig), t["key"][0].as_py()
    for i, other in _foreign(t, sig, percent):
        first = np.argmax(keys[other] == keys[i], axis=1)
        if len(other := other[keys[i][first] == key]):
            yield i, other


def _active(t: pa.Table, percent: int) -> pa.Table:
    """Rows of a tile that have a row of another component to be looked at here: as many as the tile has at most."""
    seen = np.zeros(t.num_rows, bool)
    for i, other in _offered(t, _symbols(t), percent):
        seen[i] = True
        seen[other] = True
    return t.select(["key", "rep", "n"]).filter(pa.array(seen))


def _pairs(ids: np.ndarray, found: list[tuple[int, np.ndarray]]) -> pa.Table:
    a = np.concatenate([np.full(len(o), ids[i]) for i, o in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([ids[o] for _, o in found]) if found else np.zeros(0, np.int64)
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _linked(t: pa.Table, percent: int) -> pa.Table:
    """Links between components of a tile: pairs within the signature distance, decided by their whole sets.

    Components that a link joins are one from then on, so a tile gives fewer links than it has rows."""
    sig, rep = _symbols(t), np.asarray(t["rep"])
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["s"]]
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    border = np.cumsum(size) - size
    there = np.zeros(int(flat.max()) + 1, bool)
    _, comp = np.unique(np.asarray(t["comp"]), return_inverse=True)
    a, b = [], []
    for i, other in _offered(t, sig, percent):
        other = other[comp[other] != comp[i]]
        if not len(other):
            continue
        own = flat[border[i] : border[i] + size[i]]
        there[own] = True
        # the shared shingles of row i and each other row, by one look at the rows' shingles side by side
        many = np.repeat(border[other] - (np.cumsum(size[other]) - size[other]), size[other]) + np.arange(size[other].sum())
        shared = np.add.reduceat(there[flat[many]].astype(np.int64), np.cumsum(size[other]) - size[other])
        there[own] = False
        for j in other[_similar(size[i], size[other], shared, percent)].tolist():
            if comp[j] != comp[i]:
                a.append(min(rep[i], rep[j]))
                b.append(max(rep[i], rep[j]))
                comp[comp == comp[j]] = comp[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): the smallest vertex that each vertex of (a, b) reaches, by label passing with pointer jumping.

    Labels and edges stay tables; the driver sees only whether anything changed.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("v"), "comp"), "cc-labels")
    while True:
        heard = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("comp").alias("heard"))
        best = labels.join(heard.withColumnRenamed("a", "v"), "v").select("v", F.col("comp").alias("was"), F.least("comp", "heard").alias("l"))
        jump = labels.select(F.col("v").alias("l"), F.col("comp").alias("further"))
        new = cut(best.join(jump, "l", "left").select("v", "was", F.least("l", F.coalesce("further", "l")).alias("comp")), "cc-labels")
        changed = new.filter("was != comp").limit(1).count()
        drop(labels)
        if not changed:
            drop(both)
            kept = new.select("v", "comp")
            kept.table_path = new.table_path
            return kept
        path, new = new.table_path, new.select("v", "comp")
        labels, labels.table_path = new, path


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, kept, text_md5.

    Documents are linked if their sets of `size`-word shingles have 100 * intersection >= percent * union;
    component_id is the smallest id that links reach. Documents with the same set are one vertex, so copies
    are never expanded. All pairs of signatures within DISTANCE are candidates (see CHUNKS), and each is
    decided on the whole sets. A bucket of the index first compares its rows with the one that shares most
    with others, which joins groups of copies without making their pairs; rows that stay in different
    components are compared in tiles of bounded size. Pairs of one component need no look.

    Texts without words (null, empty, white space) are linked with nothing and are kept. Rows without an id
    are linked with nothing, their component is null and they are kept. Rows that repeat an id are documents
    of their own, by their texts. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded(spark)
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = cut(base.mapInArrow(lambda it: _signed(it, size), "doc_id long, n long, h binary, sig binary, text_md5 string"), "near-signed")
    linked = signed.filter("n > 0 and doc_id is not null")
    # a vertex is a distinct set; its number is fixed by writing it
    vertices = linked.groupBy("h").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    reps = cut(vertices.withColumn("rep", F.monotonically_increasing_id()), "near-reps")
    keyed = reps.select("rep", "n", "sig").mapInArrow(_keyed, "key long, rep long, n long")
    sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "near-keys")
    buckets = cut(salted_join(keyed, sizes, sizes, "key", "rep", "rows").drop("rows"), "near-buckets")
    sigs = reps.select("rep", "sig")

    # 1. each bucket's rows against that of them which shares most with others: the centre of a group of copies
    weight = salted_join(buckets.select("key", "rep"), sizes, sizes, "key", "rep", "rows").groupBy("rep").agg(F.sum("rows").alias("weight"))
    lead = buckets.join(weight, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("o"), F.col("n").alias("n2"))).alias("s")).select("key", (-F.col("s.o")).alias("r2"), "s.n2")
    star = salted_join(buckets, lead, sizes, "key", "rep", "rows").filter(f"rep != r2 and 100 * least(n, n2) >= {percent} * greatest(n, n2)")
    star = star.select(F.least("rep", "r2").alias("a"), F.greatest("rep", "r2").alias("b")).distinct()
    both = star.join(sigs.withColumnsRenamed({"rep": "a", "sig": "sa"}), "a").join(sigs.withColumnsRenamed({"rep": "b", "sig": "sb"}), "b").select("a", "b", "sa", "sb")
    pairs = cut(both.mapInArrow(_near, "a long, b long"), "near-pairs")
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "near-wanted")
    sets = cut(_sets(base, reps, wanted, size), "near-sets")
    both = pairs.join(sets.withColumnsRenamed({"rep": "a", "s": "x"}), "a").join(sets.withColumnsRenamed({"rep": "b", "s": "y"}), "b").select("a", "b", "x", "y")
    edges = cut(both.mapInArrow(lambda it: _confirm(it, percent), "a long, b long"), "near-edges")
    drop(pairs)
    labels = components(edges)

    # 2. buckets that still hold several components: tiles of their rows
    def still_open(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with their component, of buckets with several, and the sizes of these."""
        rows = rows.join(labels.select(F.col("v").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        keys = cut(rows.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).filter("c != d").select("key", "rows", "shingles"), "near-open")
        return salted_join(rows, keys.select("key"), keys, "key", "rep", "rows"), keys

    def tiles(rows: DataFrame, keys: DataFrame, *cols: str):
        """Rows by (key, i, j): part i of a bucket meets part j of it, so a task holds two parts whatever the bucket.

        The tasks are as many as the rows of all tiles ask for, since tiles cost time rather than bytes."""
        parts = keys.select("key", "rows", F.greatest(F.ceil(F.col("rows") / TILE), F.ceil(F.col("shingles") * 8 / TILE_BYTES)).cast("int").alias("parts"))
        held = parts.agg(F.sum(F.col("rows") * F.col("parts"))).first()[0] or 0
        dealt = salted_join(rows, parts.drop("rows"), keys, "key", "rep", "rows").withColumn("part", F.pmod(F.xxhash64("rep", "key"), F.col("parts")).cast("int"))
        met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
        met = met.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), side.alias("side"), "rep", "n", "comp", *cols)
        return met.repartition(max(1, -(-held // TASK_ROWS)), "key", "i", "j").groupBy("key", "i", "j")

    rows, keys = still_open(buckets)
    active = cut(tiles(rows.join(sigs, "rep"), keys, "sig").applyInArrow(lambda t: _active(t, percent), "key long, rep long, n long").distinct(), "near-active")
    drop(buckets, keys)
    wanted2 = cut(active.select("rep").distinct().join(wanted, "rep", "left_anti"), "near-wanted")
    more = cut(_sets(base, reps, wanted2, size), "near-sets")
    rows, keys = still_open(active)
    full = rows.join(sigs.join(sets.unionByName(more), "rep"), "rep")
    new = cut(tiles(full, keys, "sig", "s").applyInArrow(lambda t: _linked(t, percent), "a long, b long"), "near-edges")
    drop(active, keys, sets, more, wanted, wanted2)
    if new.limit(1).count():
        old, labels = labels, components(edges.unionByName(new))
        drop(old)
    drop(edges, new)

    # the smallest id of each component
    placed = labels.join(reps.select(F.col("rep").alias("v"), "first"), "v")
    lows = cut(placed.groupBy("comp").agg(F.min("first").alias("low"), F.count(F.lit(1)).alias("members")), "near-lows")
    low_of = salted_join(labels.select("v", "comp"), lows.select("comp", "low"), lows, "comp", "v", "members").select(F.col("v").alias("rep"), "low")
    vertex = cut(reps.join(low_of, "rep", "left").select("h", F.coalesce("low", "first").alias("comp"), "copies"), "near-vertices")
    drop(labels, lows, reps, sizes)
    rows = signed.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("h")).alias("h"), "text_md5")
    found = salted_join(rows.filter("h is not null"), vertex.select("h", "comp"), vertex, "h", "doc_id", "copies").select("doc_id", "n", "comp", "text_md5")
    alone = rows.filter("h is null").select("doc_id", "n", F.col("doc_id").alias("comp"), "text_md5")
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("comp")).alias("kept"), "text_md5")


def _sets(base: DataFrame, reps: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, s): the whole sets of the wanted vertices, made from the texts of the first document that has them."""
    schema = pa.schema([("rep", pa.int64()), ("s", pa.binary())])

    def run(batches):
        turn("near dedup", _forget)
        for b in slices(batches, "text", SLICE):
            sets = shingle_sets(b.column(1).to_pylist(), size)
            keep = [_name(x) == h for x, h in zip(sets, b.column(2).to_pylist(), strict=True)]  # rows that repeat an id may have other texts
            yield arrow_rows(schema, rep=b.column(0), s=[x.tobytes() for x in sets]).filter(pa.array(keep, pa.bool_()))

    of = reps.join(wanted, "rep", "left_semi").select("rep", F.col("first").alias("doc_id"), "h")
    return base.join(of, "doc_id").select("rep", "text", "h").mapInArrow(run, "rep long, s binary").dropDuplicates(["rep"])


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, with all its columns.

    A row goes for its own text: rows that share an id and differ in text stand for themselves."""
    gone = cut(near_duplicates(docs, size, percent).filter("not kept").select("doc_id", "text_md5").distinct(), "near-gone")
    return without(docs, gone)


ORACLE = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
placed as (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from words where len(w) > 0),
sets as (select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as s from placed),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all),
near as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
links as (select a, b from near union all select b, a from near),
reached(v, m) as (select doc_id, doc_id from documents union select links.b, reached.m from reached join links on links.a = reached.v)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from (select v as doc_id, min(m) as component_id from reached group by v) left join sizes using (doc_id)
"""
