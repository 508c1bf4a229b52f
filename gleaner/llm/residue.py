"""Template residue and error-page text in place of real content.

A field's text is masked (numbers, addresses, dates, hex ids) and masked texts
are grouped by exact hash over all values: how many sources carry the message,
and beside how many different other fields (a reprint keeps its title, a notice
stands under any). Rules then classify the messages:

* placeholder syntax outside code spans and quotations, and texts of filler words;
* messages that recur in at least ``min_sources`` sources and beside as many
  other fields, of any length, with the vocabulary of notices in them;
* messages seen too seldom to tell by recurrence, where the sentences that hold
  a known phrase of notices, stubs or filler make up the text.

Defined cases: null and blank values are no case; replayed rows count once; a
null source counts as one source; texts about notices say other things in most
of their sentences and are no case; texts are read whole, however long.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import key128, per_batch, utf8
from gleaner.session import cut

MIN_SOURCES = 3
NOTICE = 0.3  # share of a text its notice sentences make up
SHARE = 0.15  # share of a notice sentence its phrase makes up

CODE = re.compile(r"`[^`\n]*`|```.*?```|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»|\"[^\"\n]{1,80}\"", re.S)
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|[$#]\{[^{}\n]{1,60}\}|<%[=-]?[^%\n]{1,60}%>|\{%[^%\n]{1,60}%\}|%\([A-Za-z_]+\)[sd]|(?<![\w%])%[sd](?![A-Za-z])"
    r"|%[A-Z][A-Z_]+%|\[\[[A-Za-z_ ]{1,40}\]\]|@@\w{1,40}@@|(?<!\w)__[A-Z][A-Z_]*__(?!\w)|(?<![\w{$#])\{(?:\d|[a-z][a-z_.]{0,40})\}"
    r"|<(?:INSERT|YOUR|ADD|NAME|DATE|TITLE|QUOTE)\b[A-Z_ ]{0,40}>|\[(?:YOUR|INSERT|ADD|ENTER|Your|Insert|Headline|Title|Name)\b[^\]\n]{0,40}\]|\[object Object\]",
    re.A,
)
BARE = re.compile(r"(?:\b(\w+)[ ,]+)?(?<![\w.])(undefined|NaN)(?![\w(]|\.\w)", re.A)
COPULA = {"is", "are", "was", "were", "be", "been", "remains", "remain", "left", "leaves", "ist", "sind", "es", "son", "called", "an", "or", "and"}
# fixed values: filler vocabulary
FILLER = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi"
    " aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia"
    " deserunt mollit anim id est laborum vestibulum curabitur nunc pretium orci orna ornare morbi morbus bibendum bibend feugiat feugi vestib condo condimentum nuncio erat velum sitar curabi".split()
)
# fixed values: notices, stubs and filler, per language
STRONG = re.compile(
    r"\b(?:enable|activate|turn on|requires?|needs?) (?:java ?script|scripts|cookies)|java ?script (?:is|and cookies are) (?:disabled|required|off)|only with java ?script|needs scripts to run"
    r"|too many requests|slow down and retry|something went wrong|bad gateway|gateway time-?out|upstream server|internal server error|traceback \(most recent|service (?:temporarily )?unavailable"
    r"|access (?:to this page )?(?:is |has been )?denied|automated requests|403 forbidden|404 not found|page (?:you asked for|you requested|was not found|not found|does not exist)|do not have access"
    r"|(?:need|have) to (?:sign|log) in|please (?:sign|log) in|(?:sign|log) in to (?:read|continue|view)|session (?:has )?expired|not available in your (?:region|country)"
    r"|(?:checking|verify(?:ing)?|confirm) (?:that )?you are (?:a )?human|just a moment|are you a robot|captcha"
    r"|javascript (?:aktivieren|einschalten)|aktivieren sie javascript|zugriff verweigert|seite (?:wurde )?nicht gefunden|interner serverfehler|bitte melden sie sich an|zu viele anfragen|sitzung (?:ist )?abgelaufen"
    r"|active javascript|activar? javascript|acceso denegado|página no encontrada|error interno del servidor|inicie sesión|demasiadas solicitudes|sesión (?:ha )?caducad[ao]"
    r"|启用 ?javascript|开启 ?javascript|访问过于频繁|拒绝访问|没有权限|无权访问|页面不存在|页面未找到|服务器内部错误|服务器错误|请(?:先)?登录|登录后(?:查看|阅读|继续)|会话已过期|所在地区"
    r"|goes here|sample text|replace this (?:paragraph|text)|placeholder text|(?:asdf|qwer|zxcv)\w*|test test|texto de ejemplo|sustituir antes de publicar|hier steht später|beispieltext|platzhalter|此处填写|示例文本|在此输入",
    re.I,
)
TODO = re.compile(r"^\W*(?:TODO|TBD|FIXME|TK)\b|\bTK\W*$")
TITLE = re.compile(
    r"(?:untitled(?: document| post| page)?|no title|title|headline|undefined|null|nan|none|todo.*|tbd|(?:new )?(?:post|page|article) template.*|.*\bgoes here|[(\[]?(?:headline|title|insert .*) here[)\]]?"
    r"|(?:error|http|status)? ?0(?: (?:not found|forbidden|internal server error|bad gateway|service unavailable|error))?|error:? 0.*|access denied|forbidden|page not found|not found|just a moment\W*|please wait\W*|attention required.*"
    r"|(?:are you (?:a )?(?:human|robot)|robot check|sign in|log ?in|session expired|service unavailable|internal server error|bad gateway)\W*|please enable (?:javascript|cookies).*|loading\W*|redirecting\W*"
    r"|seite nicht gefunden|zugriff verweigert|ohne titel|fehler 0|einen moment\W*|página no encontrada|acceso denegado|sin título|error interno del servidor|un momento\W*|页面不存在|页面未找到|拒绝访问|无标题|未命名|请稍候\W*|请登录|访问受限|错误 ?0)",
    re.I,
)
WEAK = re.compile(
    r"\b(?:errors?|denied|forbidden|javascript|scripts|cookies?|sign in|log in|retry|reload|refresh|try again|unavailable|maintenance|not found|expired|blocked|redirect(?:ing)?|loading|browser|requests?|template|placeholder|draft"
    r"|fehler|verweigert|anmelden|aktivieren|neu laden|wartung|nicht gefunden|denegado|recargue|inténtelo|navegador|mantenimiento|no encontrad[ao])\b|错误|登录|刷新|重试|浏览器|维护中|系统维护|过期|验证",
    re.I,
)
# fixed values: every match of STRONG holds one of the first, every match of WEAK one of the second, so that other sentences need no pattern
STRONG_SIGNS = (
    "javascript", "java script", "scripts", "cookies", "too many requests", "slow down", "went wrong", "bad gateway", "gateway", "upstream", "internal server", "traceback", "unavailable",
    "denied", "automated requests", "403 forbidden", "404 not", "page you", "not found", "does not exist", "not have access", "sign in", "log in", "expired", "not available in your",
    "human", "just a moment", "a robot", "captcha", "verweigert", "gefunden", "serverfehler", "bitte melden", "viele anfragen", "abgelaufen", "denegado", "no encontrada", "del servidor",
    "inicie", "solicitudes", "caducad", "goes here", "sample text", "replace this", "placeholder text", "asdf", "qwer", "zxcv", "test test", "texto de ejemplo", "sustituir", "hier steht",
    "beispieltext", "platzhalter", "访问", "拒绝", "权限", "无权", "页面", "服务器", "登录", "会话", "启用", "开启", "所在地区", "此处", "示例", "在此",
)
WEAK_SIGNS = (
    "error", "denied", "forbidden", "javascript", "scripts", "cookie", "sign in", "log in", "retry", "reload", "refresh", "try again", "unavailable", "maintenance", "not found", "expired",
    "blocked", "redirect", "loading", "browser", "request", "template", "placeholder", "draft", "fehler", "verweigert", "anmelden", "aktivieren", "neu laden", "wartung", "nicht gefunden",
    "denegado", "recargue", "inténtelo", "navegador", "mantenimiento", "no encontrad", "错误", "登录", "刷新", "重试", "浏览器", "维护", "过期", "验证",
)
SIGNS = tuple(dict.fromkeys(STRONG_SIGNS + WEAK_SIGNS))
_URL = re.compile(r"https?://\S+|\b[\w-]+(?:\.[\w-]+)+\b")
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b", re.I)
_DATE = re.compile(r"\b\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?")
_DIGIT = re.compile(r"\d")
_NUM = re.compile(r"\d+(?:[.,:]\d+)*")
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")


def mask(s: str) -> str:
    if "." in s or "://" in s:  # every address holds one of them
        s = _URL.sub("A", s)
    if _DIGIT.search(s):  # every date, hex id and number holds one
        s = _NUM.sub("0", _HEX.sub("H", _DATE.sub("D", s)))
    return " ".join(s.casefold().split())


def placeholder(s: str) -> bool:
    if not any(c in s for c in "{<[%@_") and "undefined" not in s and "NaN" not in s:
        return False
    t = CODE.sub(" ", s)
    if PLACEHOLDER.search(t):
        return True
    for m in BARE.finditer(t):
        if (m[1] or "").lower() not in COPULA or m[0] == t.strip():
            return True
    return False


def filler(s: str) -> bool:
    # plain words first: of a text of filler words they are filler mostly, and few other texts go on
    words = s.lower().replace(",", " ").replace(".", " ").split()
    plain = sum(map(str.isalpha, words))
    if plain >= 3 and sum(map(FILLER.__contains__, words)) < 0.4 * plain:
        return False
    w = _WORDS.findall(s.lower())
    return len(w) >= 3 and sum(x in FILLER for x in w) >= 0.75 * len(w)


def _todo(s: str) -> bool:
    return ("TK" in s or "TODO" in s or "TBD" in s or "FIXME" in s) and bool(TODO.search(s))


def _told(s: str) -> list[str]:
    """The signs of notices a text holds."""
    low = s.lower()
    return [x for x in SIGNS if x in low]


def verdict(s: str, title: bool) -> int:
    """2: residue by its own words; 1: a message with the vocabulary of notices, residue if it recurs widely; 0: none."""
    t = s.strip()
    if not t:
        return 0
    if placeholder(t) or filler(t):
        return 2
    if title:
        return 2 if TITLE.fullmatch(mask(t)) or _todo(t) else int(bool(_told(t)) and bool(WEAK.search(t)))
    bare = CODE.sub(" ", t)
    if _todo(bare):
        return 2
    if bare.count(" ") < 12 and TITLE.fullmatch(mask(t)):  # a heading's stub in place of a text
        return 2
    told = _told(bare)
    if not told:
        return 0
    strong, weak = [w for w in told if w in STRONG_SIGNS], [w for w in told if w in WEAK_SIGNS]
    low = bare.lower()
    # sentences joined where "! " or the like parts them are no shorter: an upper bound of what the notices make up
    rough = low.replace("\n", "\0").replace(". ", "\0").replace("。", "\0").split("\0")
    most = sum(len(x) + 1 for x in rough if any(map(x.__contains__, told)))
    if len(low) == len(bare) and most < NOTICE / 2 * sum(map(len, bare.split())) and not (strong and TITLE.fullmatch(mask(t.split("\n")[0]))):
        return 0
    known = notice = 0
    sentences = _SENTENCE.split(bare)
    total = sum(map(len, sentences))
    for x, low in zip(sentences, map(str.lower, sentences)):
        m = STRONG.search(x) if any(w in low for w in strong) else None
        if m and m.end() - m.start() >= SHARE * len(x):
            known += len(x)
        elif any(w in low for w in weak) and WEAK.search(x):
            notice += len(x)
        elif x.count(" ") < 12 and any(w in low for w in told) and TITLE.fullmatch(mask(x)):
            notice += len(x)
    # the notice is the text, not a remark inside a story
    if known and (known + notice >= NOTICE * total or TITLE.fullmatch(mask(t.split("\n")[0]))):
        return 2
    return int(known + notice >= NOTICE / 2 * total)


def messages(rows: DataFrame, by: list[str], min_sources: int = MIN_SOURCES) -> DataFrame:
    """(*by) of the messages that recur: rows with ``src`` and ``beside`` (hash of the other field) in ``min_sources`` of each at least."""
    kinds = rows.groupBy(*by, "src", "beside").agg(F.lit(1).alias("one"))
    per = kinds.groupBy(*by).agg(F.countDistinct("src").alias("sources"), F.countDistinct("beside").alias("besides"))
    return per.where((F.col("sources") >= min_sources) & (F.col("besides") >= min_sources))


def residue_fields(df: DataFrame, id_col: str, source_col: str, fields: dict[str, bool], min_sources: int = MIN_SOURCES) -> DataFrame:
    """(id, field_name, sure, sources) of residue; ``fields`` maps a column to whether it is a title; ``sources`` is null for messages that do not recur.

    One pass over the texts keeps only values with some evidence and the hash of
    their masked form; what is shuffled are those few rows.
    """

    def scan(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        known: dict = {}
        names = list(fields)
        for f, is_title in fields.items():
            others = [b[o] for o in names if o != f]
            for k, (i, src, v) in enumerate(zip(b["_id"], b["_src"], b[f])):
                s = utf8(v)
                if s:
                    at = (f, s)
                    if at not in known:
                        known[at] = verdict(s, is_title)
                    if known[at]:
                        beside = "\x00".join(mask(utf8(o.iloc[k])) for o in others)
                        out.append((i, f, utf8(src), known[at] == 2, key128(mask(s)), key128(beside)))
        return pd.DataFrame(out, columns=["id", "field_name", "src", "sure", "masked", "beside"])

    src = df.select(F.col(id_col).cast("string").alias("_id"), F.col(source_col).cast("string").alias("_src"), *fields).where("_id IS NOT NULL")
    hits = src.mapInPandas(per_batch(scan), "id string, field_name string, src string, sure boolean, masked binary, beside binary")
    # one row per id, field and masked text; then the spread of each masked text, again pre-aggregated
    rows = cut(hits.groupBy("id", "field_name", "masked").agg(F.max("sure").alias("sure"), F.min("src").alias("src"), F.min("beside").alias("beside")), "notices")
    wide = messages(rows, ["field_name", "masked"], min_sources).select("field_name", "masked", "sources")
    return rows.join(wide, ["field_name", "masked"], "left").where(F.col("sure") | F.col("sources").isNotNull()).groupBy("id", "field_name").agg(F.max("sure").alias("sure"), F.max("sources").alias("sources"))
