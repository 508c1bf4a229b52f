"""Claims: their terms, the evidence that mentions them, and what the arithmetic makes of a verdict.

Defined cases: a null or blank text has no terms and links to nothing; ties are
broken by length, then by order of appearance, then by id; repeated rows count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.conjunction import Postings, per_block

# fixed values: characters of grammar, which make a gram of Han characters say little
FUNCTION_CHARS = "的了是在和与或就都也很更被把从对为以于之及其并等这那们我你他她它有没有不么吗呢吧啊呀哦哪些什么怎样如何并且但因为如果所一二三四五六七八九十几半全"
# fixed values: words that are no terms
STOP = ("the", "and", "for", "with", "that", "this", "from", "have", "has", "was", "were", "will", "are", "is", "in", "on", "of", "to", "at", "by", "an", "as", "be", "it")
TOKEN = "[a-z0-9][a-z0-9_.+#-]*|[\\x{4e00}-\\x{9fff}]+"
HAN = "[\\x{4e00}-\\x{9fff}]"


def _grams(run: Column, n: int) -> Column:
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def penalty(gram: Column) -> Column:
    """How many characters of grammar a gram holds."""
    return F.length(gram) - F.length(F.translate(gram, FUNCTION_CHARS, ""))


def term_candidates(text: Column) -> Column:
    """Latin tokens, and the three- and two-character grams of Han runs, in order of appearance, once each."""

    def one(w: Column) -> Column:
        return F.when(~w.rlike("^" + HAN), F.array(w)).when(F.length(w) <= 2, F.array(w)).otherwise(F.concat(_grams(w, 3), _grams(w, 2)))

    words = F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), one))
    fine = lambda g: (F.length(g) >= 2) & ~g.isin(*STOP) & (penalty(g) <= F.when(F.length(g) == 2, 1).otherwise(2))
    return F.coalesce(F.array_distinct(F.filter(words, fine)), F.array().cast("array<string>"))


def document_frequency(texts: DataFrame, key: str, text: str, unique: bool = False) -> DataFrame:
    """(term, df) over a collection: in how many texts each candidate term stands. ``unique``: no key repeats, so that terms are counted where they are read."""
    each = texts.select(key, F.explode(term_candidates(F.col(text))).alias("term")).groupBy("term")
    return each.agg((F.count("*") if unique else F.countDistinct(key)).alias("df"))


def discriminating(claims: DataFrame, key: str, text: str, dfs: DataFrame, total: int | Column, k: int = 4) -> DataFrame:
    """(key, terms): at most k terms, the best first, none within another.

    Order: present at all, few characters of grammar, in at most a fifth of the
    collection, more frequent, longer, earlier. dfs: (term, df).
    """
    t = claims.select(key, F.posexplode(term_candidates(F.col(text))).alias("pos", "term"))
    d = F.coalesce("df", F.lit(0))
    ceiling = F.greatest(F.lit(2), F.floor((F.lit(total) if isinstance(total, int) else total) / 5))
    order = F.struct((d == 0).alias("a"), penalty(F.col("term")).alias("b"), (d > ceiling).alias("c"), (-d).alias("d"), (-F.length("term")).alias("e"), F.col("pos").alias("f"), F.col("term").alias("term"))
    ranked = t.join(dfs, "term", "left").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["term"]).alias("r"))

    def add(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda c: F.contains(c, x) | F.contains(x, c))
        return F.when((F.size(acc) >= k) | clash, acc).otherwise(F.concat(acc, F.array(x)))

    return ranked.select(key, F.aggregate("r", F.array().cast("array<string>"), add).alias("terms"))


def mentions(term: Column, blob: Column) -> Column:
    """Whether a lower-case text holds a term: as a word for Latin terms, anywhere for Han ones."""
    at = F.call_function("instr", blob, term)
    quoted = F.concat(F.lit("(?<![0-9a-z])\\Q"), F.replace(term, F.lit("\\E"), F.lit("")), F.lit("\\E(?![0-9a-z])"))
    return (F.length(term) > 0) & (at > 0) & (term.rlike("^" + HAN) | F.call_function("rlike", blob, quoted))


def link_evidence(claims: DataFrame, items: DataFrame, limit: int = 8, anchors: int = 2) -> DataFrame:
    """(claim_id, item_id, level, shared, place): the items that mention a claim.

    claims: (claim_id, terms, origin), ids unique; items: (item_id, title, content),
    ids unique. An item counts if it holds all terms; where no item does, the first
    three; where none does, the first two; and, unless it is the claim's origin, one
    of the first ``anchors`` terms as a word. Whatever the level, an item that counts
    holds the first term, and a term that stands among an item's candidates stands
    there as a word (a Latin token ends where letters and digits end), so any anchor
    is held. Claims meet the items block by block; a block gives its best level
    and the first ``limit`` items of it.
    """
    blob = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    held = items.select(F.col("item_id").alias("id"), term_candidates(blob).alias("terms"))
    kinds = {f.name: f.dataType.simpleString() for f in [*claims.schema.fields, *items.schema.fields]}

    def find(block: Postings, rows: pa.Table) -> pa.Table:
        at, levels, found, shares = [], [], [], []
        origin = None if anchors else rows.column("origin").to_pylist()
        for k, terms in enumerate(block.lists):
            places = block.all_of(terms[:2])
            if not len(places):
                continue
            has = [block.among(places, t) for t in terms[2:]]
            shared = len(terms[:2]) + sum((h.astype(np.int64) for h in has), np.zeros(len(places), np.int64))
            level = np.where(shared == len(terms), 1, np.where(has[0], 2, 3) if has else 1)
            best = int(level.min())
            keep = np.flatnonzero(level == best)
            if origin is not None:
                keep = keep[[block.ids[int(p)].as_py() == origin[k] for p in places[keep]]]
            keep = keep[np.argsort(-shared[keep], kind="stable")[:limit]]
            at.append(k)
            levels.append(best)
            found.append(places[keep])
            shares.append(shared[keep])
        ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32))
        ids = block.ids.take(pa.array(np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int64))).combine_chunks()
        return pa.table({
            "claim_id": rows.column("claim_id").take(pa.array(at, pa.int64())), "level": pa.array(levels, pa.int32()),
            "item_ids": pa.ListArray.from_arrays(ends, ids), "shared": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*shares, np.zeros(0, np.int64)]))),
        })

    got = per_block(held, items.count(), claims.select("claim_id", "terms", "origin"), find, f"claim_id {kinds['claim_id']}, level int, item_ids array<{kinds['item_id']}>, shared array<bigint>")
    # whoever has all terms has the first three too: the best level of all blocks counts
    best = Window.partitionBy("claim_id")
    kept = got.withColumn("best", F.min("level").over(best)).where("level = best").select("claim_id", "level", F.explode(F.arrays_zip("item_ids", "shared")).alias("x"))
    w = Window.partitionBy("claim_id").orderBy(F.desc("shared"), "item_id")
    kept = kept.select("claim_id", F.col("x.item_ids").alias("item_id"), "level", F.col("x.shared").alias("shared"))
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("claim_id", "item_id", "level", "shared", "place")


def bigrams(s: Column) -> Column:
    return F.when(F.length(s) >= 2, F.array_distinct(_grams(s, 2))).when(F.length(s) == 1, F.array(s)).otherwise(F.array().cast("array<string>"))


def same_statement(a: Column, b: Column, least: float = 0.85) -> Column:
    """Whether two normalised statements share nearly all character pairs of the shorter one."""
    x, y = bigrams(a), bigrams(b)
    return (a == b) | ((F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) >= least * F.least(F.size(x), F.size(y))))


def statement_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^\\p{L}\\p{N}]+", "")


def distinct_statements(sentences: Column, most: int = 12, shortest: int = 6) -> Column:
    """The statements of one item, in order: long enough, none said before, at most ``most``."""
    neat = F.filter(F.transform(sentences, lambda s: F.trim(F.regexp_replace(s, "\\s+", " "))), lambda s: F.length(s) >= shortest)
    # keys and pairs of characters once a statement, not once a comparison
    keyed = F.transform(F.transform(neat, lambda s: F.struct(s.alias("s"), statement_key(s).alias("k"))), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), bigrams(x["k"]).alias("b")))
    empty = F.array().cast("array<struct<s:string,k:string,b:array<string>>>")

    def alike(c: Column, x: Column) -> Column:
        n = F.least(F.size(c["b"]), F.size(x["b"]))
        return (c["k"] == x["k"]) | ((n > 0) & (F.size(F.array_intersect(c["b"], x["b"])) >= 0.85 * n))

    def add(acc: Column, x: Column) -> Column:
        return F.when(F.size(acc) >= most, acc).when(F.exists(acc, lambda c: alike(c, x)), acc).otherwise(F.concat(acc, F.array(x)))

    return F.transform(F.aggregate(keyed, empty, add), lambda x: x["s"])


def slug(item: Column, no: Column, text: Column) -> Column:
    """Claim id: the item, the claim's number and its first 32 characters without signs."""
    tail = F.substring(F.regexp_replace(F.lower(text), "[^0-9a-z\\x{4e00}-\\x{9fff}]+", "-"), 1, 32)
    return F.concat_ws(":", item, no.cast("string"), F.regexp_replace(tail, "^-|-$", ""))


def demote(model_verdict: Column, gate_verdict: Column) -> tuple[Column, Column]:
    """(verdict, source): the arithmetic may take 'supported' back, never grant it."""
    down = (model_verdict == "supported") & ~gate_verdict.eqNullSafe(F.lit("supported"))
    return F.when(down, "unsupported").otherwise(model_verdict), F.when(down, "trust_gate").when(model_verdict.isNotNull(), "model")
