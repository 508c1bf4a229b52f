"""Keyword-stuffed and link-list pages: bagged trees on content and link features, smoothed by host.

Features are computed once per page; weak labels come from strict rules on
them; trees are fitted on a bounded sample of weakly labelled pages
(``sample`` rows, the smallest hashes of the key, plus no other data); page
predictions are then moved by the spam rate of their host's other pages, with a
weight fitted on labelled pages.

Defined cases: null and blank texts are no spam; a null host is no host and
smooths nothing; repeated doc_ids give one row; very long texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import listed, per_batch, sample_rows, utf8, within_listed
from gleaner.llm.trees import BaggedTrees
from gleaner.session import cut, values

SAMPLE = 6000
WINDOW = 80
FEATURES = ["n", "lines", "url", "link", "hash", "slash", "stops", "func", "distinct", "digits", "line_stop", "cap", "comma", "pair", "shortline", "tab", "longrun"]
# fixed values: frequent function words of the four languages
FUNCTION = set(
    "the a an of to in on at by for from with and or but is are was were be been has have had that this it its as not no who which after before while where when than their his her they he she"
    " der die das den dem des ein eine einen einem einer und oder aber ist sind war nicht mit von für auf im am zum zur bei nach aus als dass sich wie den vor über unter nun"
    " el la los las un una unos unas de del al y o pero es son fue no con por para en que se su sus como más tras según sin sobre ya lo le hasta desde antes".split()
)
ZH_FUNCTION = re.compile("[的了是在有和与把将被从为对这没让到并而]")
_TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_ASCII_TOKEN = re.compile(r"[a-z0-9]+")
_LISTED_TOKEN = re.compile(rf"[一-鿿]|[{listed(re.compile(r'[^\W_一-鿿]').match)}]+")
_FAR_DIGIT, _FAR_CAPITAL = (re.compile(f"[{listed(f, 128)}]") for f in (str.isdigit, str.isupper))
_DIGITS, _CAPITALS = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = re.compile(r"https?://[^\s)\]]+")
_MD = re.compile(r"\[[^\]\n]{1,80}\]\(https?://[^)\s]+\)")
_STOP = re.compile(r"[.!?](?=[\s\"”]|$)|[。！？]")
_ZH = re.compile("[一-鿿]")


def _number(s: str, plain: bytes, far: re.Pattern, is_one) -> int:
    """Characters of one kind; ``plain``: those of ASCII, ``far``: those beyond."""
    if not within_listed(s):
        return sum(map(is_one, s))
    raw = s.encode("utf-8", "surrogatepass")
    return len(raw) - len(raw.translate(None, plain)) + (0 if s.isascii() else len(far.findall(s)))


def _few(line: str) -> bool:
    """Whether a line has at most four tokens; most show more at their beginning."""
    return (len(line) <= 60 or len(_TOKEN.findall(line[:60])) <= 4) and len(_TOKEN.findall(line)) <= 4


def features(text: str) -> list[float]:
    s = text.strip()
    urls = _URL.findall(s)
    url_chars = sum(map(len, urls))
    md = len(_MD.findall(s))
    bare = _URL.sub(" ", s)
    lines = [x.strip() for x in bare.split("\n") if x.strip()]
    ascii_ = bare.isascii()
    words = _ASCII_TOKEN.findall(bare.lower()) if ascii_ else [w.lower() for w in (_LISTED_TOKEN if within_listed(bare) else _TOKEN).findall(bare)]
    n = max(1, len(words))
    zh = 0 if ascii_ else len(_ZH.findall(bare))
    spans = _STOP.split(bare)
    stops = len(spans) - 1
    units = n if zh < n / 2 else n / 1.6
    func = sum(map(FUNCTION.__contains__, words)) + (0 if ascii_ else len(ZH_FUNCTION.findall(bare)))
    # repetition is measured in windows, so that it does not grow with the length of a text
    pair = distinct = 0.0
    windows = range(0, n if words else 0, WINDOW)
    for at in windows:
        w = words[at : at + WINDOW]
        if at and len(w) < WINDOW // 2:
            w = words[-WINDOW:]
        pair += 1 - len(set(zip(w, w[1:]))) / max(1, len(w) - 1)
        distinct += len(set(w)) / len(w) ** 0.9
    pair, distinct = pair / max(1, len(windows)), distinct / max(1, len(windows))
    run = max(map(len, spans))
    return [
        np.log1p(n), np.log1p(len(lines)), url_chars / max(1, len(s)), (md or len(urls)) * 20 / n, bare.count("#") * 4 / n, bare.count(" / ") * 4 / n,
        stops * 15 / units, func / n, distinct, _number(bare, _DIGITS, _FAR_DIGIT, str.isdigit) / max(1, len(bare)),
        sum(bool(_STOP.search(x[-2:])) for x in lines) / max(1, len(lines)), _number(bare, _CAPITALS, _FAR_CAPITAL, str.isupper) / max(1, len(bare)), (bare.count(",") + bare.count("，") + bare.count(";")) * 10 / n,
        pair, sum(_few(x) for x in lines) / max(1, len(lines)), bare.count("\t") * 5 / n, run / max(1, len(bare)),
    ]


def weak_label(f: np.ndarray) -> np.ndarray:
    """1 spam, 0 not, -1 no label, by strict rules on the features."""
    g = {k: f[:, i] for i, k in enumerate(FEATURES)}
    long = g["n"] > np.log1p(18)
    few = g["stops"] < 0.35
    spam = long & (
        ((g["url"] > 0.45) & few)
        | ((g["hash"] > 1.6) & few)
        | ((g["slash"] > 0.8) & few)
        | ((g["link"] > 3.0) & few & (g["func"] < 0.12))
        | (g["pair"] > 0.4)
        | ((g["func"] < 0.04) & ((g["stops"] < 0.08) | (g["stops"] > 2.2)) & (g["tab"] == 0) & (g["line_stop"] < 0.6) & (g["cap"] < 0.08))
    )
    ham = (g["func"] > 0.1) & (g["pair"] < 0.22) & (g["url"] < 0.3) & (g["hash"] < 1.0) & (g["slash"] < 0.3)
    ham |= (g["line_stop"] > 0.5) & (g["pair"] < 0.22) & (g["func"] > 0.05)
    ham |= (g["tab"] > 0.3) & (g["pair"] < 0.4)
    return np.where(spam & ~ham, 1, np.where(ham & ~spam, 0, -1))


def page_features(df: DataFrame, key: str, text: str, host: str | None) -> DataFrame:
    def run(b: pd.DataFrame) -> pd.DataFrame:
        keep = b[b["_t"].map(lambda x: bool(utf8(x).strip()))]
        f = [np.asarray(features(t), dtype=np.float32).tobytes() for t in keep["_t"]]
        return pd.DataFrame({"_k": keep["_k"], "_h": keep["_h"], "f": f})

    src = df.select(F.col(key).alias("_k"), (F.col(host) if host else F.lit(None).cast("string")).alias("_h"), F.col(text).alias("_t")).where("_k IS NOT NULL AND _t IS NOT NULL")
    kind = dict(df.dtypes)[key]
    return src.mapInPandas(per_batch(run), f"_k {kind}, _h string, f binary")


def matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.float32).reshape(-1, len(FEATURES)).astype(float)


def fit(feature_rows: DataFrame, sample: int = SAMPLE) -> tuple[BaggedTrees, list[tuple]]:
    """Trees from at most ``sample`` rows of features (numbers only reach the driver), and (key, host, out-of-bag probability, weak label) of the labelled ones."""
    got = sample_rows(feature_rows, "_k", sample)
    if not got:
        return BaggedTrees(np.zeros((0, len(FEATURES))), np.zeros(0)), []
    x = matrix(bytes(r["f"]) for r in got)
    y = weak_label(x)
    known = np.flatnonzero(y >= 0)
    model = BaggedTrees(x[known], y[known])
    p = model.out_of_bag if model.constant is None else y[known].astype(float)
    return model, [(got[k]["_h"], float(v), int(y[k])) for k, v in zip(known, p)]


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


# what is believed before looking: the page counts whole, its host by half; and how many pages that belief is worth
BELIEF = np.array([0.0, 1.0, 0.5])
WORTH = 10.0


def weights(page: np.ndarray, host: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(bias, weight of the page's log-odds, weight of its host's) by logistic regression on labelled pages, drawn towards ``BELIEF``; weights are not negative."""
    w = BELIEF.copy()
    if len(label) == 0 or label.min() == label.max():
        return w
    x = np.column_stack([np.ones(len(page)), page, host])
    share = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))  # both classes weigh the same
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (label - p)) - WORTH * (w - BELIEF)
        h = (x * (share * p * (1 - p))[:, None]).T @ x + WORTH * np.eye(3)
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return np.array([w[0], max(w[1], 0.0), max(w[2], 0.0)])


def scored(df: DataFrame, key: str, text: str, host: str | None = None, sample: int = SAMPLE, lean: float = 20.0) -> DataFrame:
    """(key, host, page, host_rate, score): the page's own probability, its host's rate and the smoothed score.

    A host's rate is that of its other pages, leaning on the overall rate by
    ``lean`` pages. How far it moves a page is fitted on labelled pages, judged by
    the trees that did not see them.
    """
    rows = cut(page_features(df, key, text, host), "features")
    model, labelled = fit(rows, sample)

    def predict(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_k": b["_k"], "_h": b["_h"], "page": model.predict(matrix(b["f"]))})

    pages = rows.mapInPandas(per_batch(predict), f"_k {dict(rows.dtypes)['_k']}, _h string, page double").groupBy("_k", "_h").agg(F.max("page").alias("page"))
    pages = cut(pages, "pages")
    overall = float(pages.agg(F.avg((F.col("page") > 0.5).cast("double"))).first()[0] or 0.0)
    # hosts are pre-aggregated
    hosts = cut(pages.where("_h IS NOT NULL").groupBy("_h").agg(F.sum((F.col("page") > 0.5).cast("double")).alias("bad"), F.count("*").cast("double").alias("n")), "hosts")
    asked = sorted({h for h, _, _ in labelled if h is not None})
    rate = {r["_h"]: (r["bad"], r["n"]) for r in hosts.join(F.broadcast(values(df.sparkSession, [(h,) for h in asked], "_h string")), "_h").collect()} if asked else {}  # hosts of the sample
    base = logit(np.array([overall]))[0]
    use = [(p, *rate[h], y) for h, p, y in labelled if h in rate]
    if use:
        p, bad, n, y = (np.array(c, dtype=float) for c in zip(*use))
        others = (bad - (p > 0.5) + lean * overall) / np.maximum(n - 1 + lean, 1.0)
        w = weights(logit(p), logit(others) - base, y)
    else:
        w = BELIEF
    own = (F.col("page") > 0.5).cast("double")
    at = F.coalesce((F.col("bad") - own + F.lit(lean * overall)) / (F.col("n") - 1 + F.lit(lean)), F.lit(overall))
    odds = lambda c: F.log(F.greatest(F.least(c, F.lit(1 - 1e-3)), F.lit(1e-3)) / F.greatest(F.lit(1.0) - c, F.lit(1e-3)))
    out = pages.join(hosts, "_h", "left").withColumn("host_rate", at)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(w[0])) + float(w[1]) * odds(F.col("page")) + float(w[2]) * (odds(F.col("host_rate")) - F.lit(float(base))))))
    return out.select(F.col("_k").alias(key), F.col("_h").alias("host"), "page", "host_rate", score.alias("score"))
