"""Public endpoints as data: where each one's rows are and which paths hold which field; the planner that picks among them.

The paths are those of the services' public documentation. Reading them is
:func:`gleaner.sources.json_rows.parse`; fetching is left to the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.json_rows import SourceSpec


@dataclass(frozen=True)
class Endpoint:
    """A source with its address, what it covers and what it needs."""

    spec: SourceSpec
    url: str
    fmt: str = "json"
    coverage: tuple[str, ...] = ("en",)
    needs_key: str = ""
    needs_browser: bool = False

    @property
    def mode(self) -> str:
        """How it is read: browser, search, feed, page or snapshot."""
        if self.needs_browser:
            return "browser"
        if "{query}" in self.url:
            return "search"
        return {"rss": "feed", "html": "page"}.get(self.fmt, "snapshot")


ENDPOINTS = [
    Endpoint(SourceSpec("github_issues", "issue", "items", url=("html_url",), date=("created_at",), author=("user.login",), body=("body",), metrics={"replies": "comments", "likes": "reactions.total_count"}), "https://api.github.com/search/issues?q={query}&page={page}"),
    Endpoint(SourceSpec("github_repos", "repository", "items", title=("full_name",), url=("html_url",), date=("pushed_at",), author=("owner.login",), body=("description",), metrics={"likes": "stargazers_count"}), "https://api.github.com/search/repositories?q={query}&page={page}"),
    Endpoint(SourceSpec("hackernews", "story", "hits", title=("title", "story_title"), url=("url", "story_url"), date=("created_at_i", "created_at"), body=("story_text", "comment_text"), metrics={"likes": "points", "replies": "num_comments"}), "https://hn.algolia.com/api/v1/search?query={query}&page={page}"),
    Endpoint(SourceSpec("reddit", "post", "data.children", title=("data.title",), url=("data.permalink",), date=("data.created_utc",), author=("data.author",), body=("data.selftext",), metrics={"likes": "data.score", "replies": "data.num_comments"}, url_prefix="https://www.reddit.com"), "https://www.reddit.com/search.json?q={query}&after={cursor}"),
    Endpoint(SourceSpec("v2ex", "topic", "", date=("created",), author=("member.username",), body=("content",), metrics={"replies": "replies"}), "https://www.v2ex.com/api/topics/latest.json", coverage=("zh",)),
    Endpoint(SourceSpec("discourse", "topic", "topic_list.topics", url=("slug",), date=("created_at",), body=("excerpt",), metrics={"replies": "posts_count", "likes": "like_count", "views": "views"}, url_prefix="https://forum.example/t/"), "https://forum.example/latest.json?page={page}"),
    Endpoint(SourceSpec("bilibili", "video", "data.result", url=("arcurl",), date=("pubdate",), author=("author",), body=("description",), metrics={"views": "play", "likes": "like", "replies": "review"}), "https://api.bilibili.com/x/web-interface/search/type?keyword={query}&page={page}", coverage=("zh",)),
    Endpoint(SourceSpec("youtube", "video", "items", title=("snippet.title",), url=("id.videoId",), date=("snippet.publishedAt",), author=("snippet.channelTitle",), body=("snippet.description",), url_prefix="https://www.youtube.com/watch?v="), "https://www.googleapis.com/youtube/v3/search?part=snippet&q={query}&pageToken={cursor}", needs_key="YOUTUBE_KEY"),
    Endpoint(SourceSpec("gdelt", "article", "articles", date=("seendate",), author=("domain",)), "https://api.gdeltproject.org/api/v2/doc/doc?query={query}&format=json"),
    Endpoint(SourceSpec("stackexchange", "question", "items", url=("link",), date=("creation_date",), author=("owner.display_name",), metrics={"likes": "score", "replies": "answer_count", "views": "view_count"}), "https://api.stackexchange.com/2.3/search/advanced?q={query}&page={page}"),
    Endpoint(SourceSpec("openalex", "paper", "results", title=("display_name",), url=("doi", "id"), date=("publication_date",), author=("authorships[0].author.display_name",), metrics={"cites": "cited_by_count"}), "https://api.openalex.org/works?search={query}&page={page}"),
    Endpoint(SourceSpec("crossref", "paper", "message.items", title=("title[0]",), url=("URL",), date=("created.date-time",), author=("author[0].family",), body=("abstract",), metrics={"cites": "is-referenced-by-count"}), "https://api.crossref.org/works?query={query}&offset={cursor}"),
    Endpoint(SourceSpec("devto", "post", "", url=("url",), date=("published_at",), author=("user.name",), body=("description",), metrics={"likes": "public_reactions_count", "replies": "comments_count"}), "https://dev.to/api/articles?page={page}"),
    Endpoint(SourceSpec("juejin", "post", "data", title=("result_model.article_info.title",), url=("result_model.article_id",), date=("result_model.article_info.ctime",), author=("result_model.author_user_info.user_name",), body=("result_model.article_info.brief_content",), url_prefix="https://juejin.cn/post/"), "https://api.juejin.cn/search_api/v1/search?query={query}&cursor={cursor}", coverage=("zh",)),
    Endpoint(SourceSpec("telegram", "message", "messages", title=("text",), url=("link",), date=("date",), author=("from",), body=("text",), metrics={"views": "views"}), "https://t.me/s/{channel}", fmt="html", coverage=("en", "zh")),
    Endpoint(SourceSpec("google_news", "article", "items"), "https://news.google.com/rss/search?q={query}", fmt="rss", coverage=("en", "zh", "de", "es")),
]


def planned(coverage: set[str], kinds: set[str] | None = None, keys: set[str] = frozenset(), browser: bool = False) -> list[tuple[Endpoint, str]]:
    """Every endpoint with why it is left out ('' if it is not): search endpoints first, in the order of the list."""

    def reason(e: Endpoint) -> str:
        if not coverage & set(e.coverage):
            return "coverage"
        if kinds is not None and e.spec.kind not in kinds:
            return "kind"
        if e.needs_key and e.needs_key not in keys:
            return "key"
        return "browser" if e.needs_browser and not browser else ""

    return sorted(((e, reason(e)) for e in ENDPOINTS), key=lambda x: (bool(x[1]), x[0].mode != "search"))


def read_shards(spark: SparkSession, glob: str, schema: str, key: str) -> DataFrame:
    """Rows of many collector files (JSON lines), the first file in name order wins a key; lines that cannot be read are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(glob).select("*", F.col("_metadata.file_name").alias("_file"))
    names = [c for c in rows.columns if c not in ("_bad", "_file", key)]
    one = rows.where(F.col("_bad").isNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*names), F.struct("_file", *names)).alias("_r"))
    return one.select(key, "_r.*")
