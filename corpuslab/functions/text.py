"""Scalar text expressions. All but Unicode normal forms stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Unicode white space and word characters as Java (and RE2) classes: `\s` and `\w` there are ASCII only.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\p{Z}"
WORD = "[\\p{L}\\p{N}_]+"
#: Characters that normalisation deletes, besides the no-break space that it makes a space.
ZERO_WIDTH = "​‌‍﻿"


@pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """NFKD without what isn't ASCII."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_text(c: Column, unicode_form: bool = True, nbsp: bool = True, zero_width: bool = True, collapse: bool = True, trim: bool = True) -> Column:
    """NFC, no-break spaces, zero-width characters, runs of white space, ends: in this order, each optional; null is empty."""
    c = F.coalesce(c, F.lit(""))
    c = nfc(c) if unicode_form else c
    c = F.translate(c, " ", " ") if nbsp else c
    c = F.translate(c, ZERO_WIDTH, "") if zero_width else c
    c = squeeze(c) if collapse else c
    return strip(c) if trim else c


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def space_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"([^{SPACE}]+)"), F.lit(1))


def n_space_tokens(c: Column) -> Column:
    return F.size(space_tokens(c)).cast("long")


def has_letter(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("\\p{L}")


def marker_form(c: Column) -> Column:
    """Lower case, single spaces, ASCII only, without . , : ; ! ? and apostrophes: for spotting commentary."""
    return F.translate(ascii_fold(strip(squeeze(F.lower(c)))), "'.,:;!?", "")


def plain_form(c: Column) -> Column:
    return ascii_fold(F.lower(c))


def lexical_item(c: Column) -> Column:
    """Single spaces, stripped, lower case; null if nothing is left."""
    return F.nullif(F.lower(strip(squeeze(c))), F.lit(""))


def row_id(prefix: Column | str, index: Column) -> Column:
    """prefix_000001 for the row at index 0."""
    return F.format_string("%s_%06d", F.lit(prefix) if isinstance(prefix, str) else prefix, index + 1)


def units(c: Column) -> Column:
    """Blocks between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, f"\\n[{SPACE}]*\\n"), strip), lambda x: x != "")


def tag_units(c: Column, n: int) -> Column:
    """<s1>..</s1> lines, one for each unit; null unless there are exactly n."""
    tagged = F.transform(units(c), lambda x, i: F.concat(F.lit("<s"), (i + 1).cast("string"), F.lit(">"), x, F.lit("</s"), (i + 1).cast("string"), F.lit(">")))
    return F.when(F.size(units(c)) == n, F.array_join(tagged, "\n"))


# Names a tag may have, its form (models leave out the last bracket).
TAG_NAMES = "s|sentence|sententzia"
TAG = rf"</?\s*(?:{TAG_NAMES})_?\d+\s*>?"
_UNIT = rf"<\s*(?:{TAG_NAMES})_?(?P<no>\d+)\s*>?\s*(?P<text>.*?)\s*</\s*(?:{TAG_NAMES})_?(?P=no)\s*>"


def strip_tags(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"(?i){TAG}", ""))


def unit_prompt(n: int) -> str:
    """The instruction for n tagged units, with fields {target_lang} and {source}."""
    # fixed values: the wording and the form
    shape = "\n".join(f"<s{i}>translation {i}</s{i}>" for i in range(1, n + 1))
    rules = "Translate each sentence into {target_lang} without merging, omitting, adding, or renumbering sentences. Copy the short tags exactly and write nothing outside them. Return exactly this structure:"
    return f"The input contains {n} separately tagged English sentences. {rules}\n{shape}\n\n" + "{source}"


def extract_units(n: int):
    """A function of a text column: struct(text, valid, error) with the units of a tagged answer, which must be 1 to n in order."""
    pattern = re.compile(_UNIT, re.I | re.S)
    tag = re.compile(TAG, re.I)
    wanted = list(range(1, n + 1))

    @pandas_udf("text string, valid boolean, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            found = [(int(m["no"]), m["text"].strip()) for m in pattern.finditer(x or "")]
            numbers = [i for i, _ in found]
            error = f"expected tagged sentence indexes {wanted}, found {numbers}" if numbers != wanted else "one or more tagged translations are empty" if not all(t for _, t in found) else None
            out.append((tag.sub("", x or "").strip() if error else "\n\n".join(t for _, t in found), error is None, error))
        return pd.DataFrame(out, columns=["text", "valid", "error"])

    return run


#: Names of languages in prompts.
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "eu": "Basque", "ca": "Catalan"}


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(names, code), code)


def render(template: str, **values: Column) -> Column:
    """A template with {name} fields, filled by columns; what these hold is not filled again."""
    parts = re.split("{(" + "|".join(map(re.escape, values)) + ")}", template) if values else [template]
    return F.concat(*[F.coalesce(values[x], F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(user: Column, system: Column | None = None, assistant: Column | None = None) -> Column:
    """A chat: an optional system turn, the user's, an optional answer."""
    return F.array(*[message(r, c) for r, c in (("system", system), ("user", user), ("assistant", assistant)) if c is not None])


def content_parts(chat: Column) -> Column:
    """Each message's content as a list of typed parts, for models that take those."""
    return F.transform(chat, lambda m: F.struct(m.role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), m.content.alias("text"))).alias("content")))


def completion_text(chat: Column) -> Column:
    """The content of the last message that has one."""
    return F.element_at(F.filter(chat, lambda m: m.content.isNotNull()), -1).content


def alignment_text(pairs: Column) -> Column:
    """i-j i-j ... for an array of structs (i, j)."""
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("-", p.i.cast("string"), p.j.cast("string"))), " ")


def alignment_pairs(c: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != ""), lambda x: F.struct(F.split(x, "-")[0].cast("int").alias("i"), F.split(x, "-")[1].cast("int").alias("j")))


def metric_label(key: Column) -> tuple[Column, Column]:
    """Title-case labels of `section.metric`: the part before the last dot and the part after it."""
    title = lambda c: F.initcap(F.translate(c, "_", " "))
    section = F.when(F.instr(key, ".") > 0, F.regexp_extract(key, r"^(.*)\.[^.]*$", 1)).otherwise("")
    return title(section), title(F.substring_index(key, ".", -1))
