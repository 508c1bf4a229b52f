"""Visually identical text with different characters: one consistent form.

``canonical`` applies compatibility normalisation (composed form), maps every
kind of white space but the line break to a plain space, removes
default-ignorable characters and turns look-alike letters of other scripts into
Latin ones. ``fold=True`` adds full case folding; the pair query leaves it off,
as letter case is a visible difference there.

Defined cases: null stays null; blank stays blank and takes no part in pairs;
super-/subscripts, circled forms and fractions are visible differences and stay;
a joiner between two emoji changes what is seen and stays; words wholly of
another script that hold a letter without a Latin twin stay as they are.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import key128, per_batch, utf8
from gleaner.session import cut

# fixed values: letters of other scripts and the Latin letters they look like
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "h",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ӏ": "l", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "α": "a", "ϲ": "c", "ϳ": "j",
    "ı": "i", "ɡ": "g", "ɑ": "a", "Տ": "S", "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g",
}
_LOOK = str.maketrans(LOOKALIKES)
_FOREIGN = re.compile("[" + "".join(LOOKALIKES) + "]")
_WORD = re.compile(r"[^\W_]+")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_EMOJI = "\U0001f000-\U0001faff☀-➿️\U0001f3fb-\U0001f3ff"
_IGNORABLE = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​‌‎‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
    f"|(?<![{_EMOJI}])‍|‍(?![{_EMOJI}])"
)
_SPACE = re.compile("[\t\x0b\x0c\x1f    -   　]+")
_BREAK = re.compile("\r\n?| | |\x85")
_EDGE = re.compile(" ?\n ?")


def _visible(c: str) -> bool:
    return unicodedata.decomposition(c).startswith(("<super>", "<sub>", "<circle>", "<fraction>", "<square>"))


def _letters(m: re.Match) -> str:
    w = m[0]
    if not _FOREIGN.search(w):
        return w
    rest = w.translate(_LOOK)
    # a word of another script keeps its letters unless all of it reads as Latin
    if _LATIN.search(w) or rest.isascii():
        return rest
    return w


def canonical(s: str | None, fold: bool = False) -> str | None:
    if s is None:
        return None
    if not s.isascii():
        s = _IGNORABLE.sub("", _BREAK.sub("\n", s))
        if not unicodedata.is_normalized("NFKC", s):
            odd = {c for c in set(s) if ord(c) > 127 and _visible(c)}
            if odd:
                s = "".join(c if c in odd else unicodedata.normalize("NFKC", c) if unicodedata.decomposition(c).startswith("<") else c for c in s)
                s = unicodedata.normalize("NFC", s)
            else:
                s = unicodedata.normalize("NFKC", s)
        if _FOREIGN.search(s):
            s = unicodedata.normalize("NFC", _WORD.sub(_letters, s))
    elif "\r" in s:
        s = _BREAK.sub("\n", s)
    s = _EDGE.sub("\n", _SPACE.sub(" ", s)).strip()
    return s.casefold() if fold else s


def canonical_columns(df: DataFrame, columns: list[str], fold: bool = False) -> DataFrame:
    """``df`` with each named column in its canonical form; each distinct value of a batch is handled once."""

    @F.pandas_udf("string")
    def one(v: pd.Series) -> pd.Series:
        known: dict = {}
        return v.map(lambda x: x if x is None else known[x] if x in known else known.setdefault(x, canonical(x, fold)))

    return df.withColumns({c: one(F.col(c)) for c in columns})


def alike_pairs(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(field_name, id_a, id_b): two ids whose value reads the same but is another string.

    Only keys of 16 bytes are shuffled. Forms are grouped by reading first, so a
    reading with a single spelling (nearly all) leaves before any join, pairs
    are built between spellings and only then expanded to ids; ids that share a
    spelling never meet.
    """

    def keys(b: pd.DataFrame) -> pd.DataFrame:
        ids, fs, ks, rs = [], [], [], []
        known: dict = {}
        for c in columns:
            for i, v in zip(b["_id"], b[c]):
                s = utf8(v)
                if s not in known:
                    k = canonical(s)
                    known[s] = (key128(k), key128(s)) if k else None
                if known[s]:
                    ids.append(i)
                    fs.append(c)
                    ks.append(known[s][0])
                    rs.append(known[s][1])
        return pd.DataFrame({"id": ids, "field_name": fs, "reading": ks, "spelling": rs})

    src = df.select(F.col(id_col).cast("string").alias("_id"), *columns).where("_id IS NOT NULL")
    rows = cut(src.mapInPandas(per_batch(keys), "id string, field_name string, reading binary, spelling binary"), "readings")
    many = rows.groupBy("field_name", "reading").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("field_name", "reading")
    open_ = cut(rows.join(many, ["field_name", "reading"]).distinct(), "spellings")
    forms = open_.select("field_name", "reading", "spelling").distinct()
    a, b = forms.withColumnRenamed("spelling", "sa"), forms.withColumnRenamed("spelling", "sb")
    both = a.join(b, ["field_name", "reading"]).where("sa < sb")
    left = open_.select("field_name", "reading", F.col("spelling").alias("sa"), F.col("id").alias("ia"))
    right = open_.select("field_name", "reading", F.col("spelling").alias("sb"), F.col("id").alias("ib"))
    pairs = both.join(left, ["field_name", "reading", "sa"]).join(right, ["field_name", "reading", "sb"]).where("ia <> ib")
    return pairs.select("field_name", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
