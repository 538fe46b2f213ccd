"""Column functions on texts, queries and HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.config import BLOG_PARTS, DEFAULT, DOC_PARTS, DROPPED_TAGS, STOP_WORDS, Config

# Markup and what it becomes, in the order in which it is put.
MARKDOWN_RULES = (
    (r"(?is)<head(?:\s[^>]*)?>.*?</head>", " "),
    (r"\s+", " "),
    *((rf"(?i) ?<h{n}(?:\s[^>]*)?> ?", "\n\n" + "#" * n + " ") for n in range(1, 7)),
    (r"(?i) ?</h[1-6]> ?", "\n\n"),
    (r"(?i) ?<li(?:\s[^>]*)?> ?(?:<p(?:\s[^>]*)?> ?)?", "\n- "),
    (r"(?i) ?</li> ?", ""),
    (r"(?i) ?</t[dh]> ?", " | "),
    (r"(?i) ?<hr(?:\s[^>]*)?/?> ?", "\n\n---\n\n"),
    (r"(?i) ?<br(?:\s[^>]*)?/?> ?", "\n"),
    (r"(?i) ?<blockquote(?:\s[^>]*)?> ?(?:<p(?:\s[^>]*)?> ?)?", "\n\n> "),
    (r"(?i) ?</?(?:p|div|ul|ol|section|article|main|body|html|table|tr|blockquote|pre|figure)(?:\s[^>]*)?> ?", "\n\n"),
    (r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**"),
    (r"(?i)</?(?:i|em)(?:\s[^>]*)?>", "*"),
    (r"(?i)</?code(?:\s[^>]*)?>", "`"),
    (r'(?i)<img\s[^>]*?alt="([^"]*)"[^>]*>', "$1"),
    (r'(?i)<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>', "[$2]($1)"),
    (r"<[^>]*>", ""),
    (r"[ ]*\n[ ]*", "\n"),
    (r"\n(?:-\n)+", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"^\s+|\s+$", ""),
)
MARKDOWN_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))


def words(text: Column) -> Column:
    """White-space separated words; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def keywords(query: Column) -> Column:
    """Lower-case words that are no stop words, joined by blanks; the query itself if none is left."""
    kept = F.filter(words(F.lower(query)), lambda w: ~w.isin(*STOP_WORDS))
    return F.when(F.size(kept) == 0, query).otherwise(F.array_join(kept, " "))


def heuristic_score(url: Column, query: Column, config: Config = DEFAULT) -> Column:
    """Share of the query's words that are parts of the URL, weighted."""
    parts = F.array_distinct(F.split(F.lower(url), r"[/\-_?=&.]"))
    asked = F.array_distinct(words(F.lower(query)))
    share = F.least(F.size(F.array_intersect(parts, asked)) / F.size(asked), F.lit(1.0))
    return F.when(F.size(asked) == 0, F.lit(config.heuristic_default)).otherwise(F.round(share * config.heuristic_weight, 3))


def _any_part(url: Column, parts: tuple[str, ...]) -> Column:
    return F.lower(url).rlike("|".join(parts))


def strategy(url: Column, score: Column, config: Config = DEFAULT) -> Column:
    docs, blog = _any_part(url, DOC_PARTS), _any_part(url, BLOG_PARTS)
    return (
        F.when((score >= config.band_adaptive) & docs, "adaptive_crawl")
        .when((score >= config.band_deep) & (docs | blog), "deep_crawl")
        .when(score >= config.band_crawl, "crawl_url")
        .otherwise("skip")
    )


def cut(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def cut_noted(text: Column, n: int) -> Column:
    """First ``n`` characters; what is left out is counted."""
    more = F.concat(cut(text, n), F.lit("…[truncated "), (F.length(text) - n).cast("string"), F.lit(" chars]"))
    return F.when(F.length(text) > n, more).otherwise(text)


def capped(text: Column, config: Config = DEFAULT) -> Column:
    """At most so many characters as the token cap stands for."""
    return cut(text, int(config.token_cap * config.chars_per_token))


def slug(query: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), "[^a-z0-9]+", "-")
    s = cut(F.regexp_replace(s, "^-+|-+$", ""), 40)
    return F.when(s == "", F.lit("query")).otherwise(s)


def session_name(query: Column, now: Column) -> Column:
    return F.concat(F.date_format(now, "yyyyMMdd-HHmmss"), F.lit("_"), slug(query))


def prompt_session(topic: Column) -> Column:
    return F.concat(cut(F.replace(F.lower(topic), F.lit(" "), F.lit("_")), 40), F.lit("_session"))


def mapped(key: Column, table: dict[str, str], default: str) -> Column:
    """Value of a code in a small table, without regard to case; else the default."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.lower(key)), F.lit(default))


def content_id(*parts: Column) -> Column:
    """Id that follows from contents, so that reruns agree."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def acquirer_prompt(question: Column, depth: Column, source_classes: Column) -> Column:
    return F.concat(F.lit("Depth: "), depth, F.lit("\nSource classes: "), F.array_join(source_classes, ", "), F.lit("\nQuestion: "), question)


# HTML

def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def description(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<meta\s+name=\"description\"\s+content=\"([^\"]*)\"", 1)


def clean_html(html: Column) -> Column:
    """Without comments and the tags that hold no article text."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in DROPPED_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", " ")
    return out


def html_text(html: Column) -> Column:
    """Text of cleaned HTML: tags become blanks, white space runs become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(clean_html(html), r"(?s)<[^>]*>", " "), r"\s+", " "))


def markdown(html: Column, clean: bool = True) -> Column:
    """Markdown of HTML, cleaned first or as it is: headings, list items, links, emphasis, code, quotes,
    rules, cells and paragraphs. A definition of our own: blocks are parted by a blank line, items by a
    line end; white space runs within a line are one blank; what markup is left goes; null stays
    null. Entities are resolved last, so that they never become markup."""
    out = clean_html(html) if clean else html
    for pattern, put in MARKDOWN_RULES:
        out = F.regexp_replace(out, pattern, put)
    for entity, char in MARKDOWN_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def sections(text: Column) -> Column:
    """Sections of Markdown, in order: level of the heading (0 before the first), heading and body."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=#{1,6} )"), lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" "))) != "")

    def section(part):
        mark = F.regexp_extract(part, r"^(#{1,6}) ", 1)
        head = F.regexp_extract(part, r"^#{1,6} ([^\n]*)", 1)
        body = F.regexp_replace(F.regexp_replace(part, r"^#{1,6} [^\n]*", ""), r"^\n+|\n+$", "")
        return F.struct(F.length(mark).alias("level"), head.alias("heading"), body.alias("body"))

    return F.transform(parts, section)


def raw_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def fit_or_raw(fit: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(fit, F.lit("")), raw)


def links(html: Column) -> Column:
    """Targets of the anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def gb_figures(line: Column) -> Column:
    """Largest figure before GB in a line, or null."""
    found = F.regexp_extract_all(line, F.lit(r"(\d+(?:\.\d+)?)\s+GB"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.cast("double")))
