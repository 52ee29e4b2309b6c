"""SQL (DuckDB dialect) twins of the adapter views, used by the oracle queries."""
from __future__ import annotations

from ..functions.text import (NON_ALNUM_PATTERN, SPACE_PATTERN, STOP_WORDS, TAG_PATTERN, URL_PATTERN)


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP_LIST_SQL = "[" + ", ".join(sql_str(w) for w in STOP_WORDS) + "]"


def sql_normalize(expr: str) -> str:
    x = f"lower({expr})"
    x = f"regexp_replace({x}, {sql_str(URL_PATTERN)}, ' ', 'g')"
    x = f"regexp_replace({x}, {sql_str(TAG_PATTERN)}, ' ', 'g')"
    x = f"regexp_replace({x}, {sql_str(NON_ALNUM_PATTERN)}, ' ', 'g')"
    x = f"regexp_replace({x}, {sql_str(SPACE_PATTERN)}, ' ', 'g')"
    return f"trim({x})"


def sql_clean(expr: str) -> str:
    return (f"coalesce(array_to_string(list_filter(string_split({sql_normalize(expr)}, ' '), "
            f"lambda w: NOT list_contains({STOP_LIST_SQL}, w)), ' '), '')")


def sql_parse_ids(expr: str) -> str:
    return (f"CASE WHEN {expr} IS NULL OR lower(trim({expr})) IN ('', 'nan', 'none', '[]') "
            f"THEN []::VARCHAR[] ELSE list_filter(regexp_split_to_array(trim({expr}), '[,\\t;|\\s]+'), "
            f"lambda p: p <> '' AND regexp_matches(p, '\\d')) END")


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "articles": ((), """
        SELECT CAST(d.doc_id AS VARCHAR) AS news_id, d.text AS text, d.source AS source,
               CAST(l.quality AS INTEGER) AS label
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "tweets": ((), """
        SELECT e.event_id AS tweet_id, e.user_id AS user_id,
               CAST((CAST(json_extract_string(e.props, '$.k') AS BIGINT) * e.user_id)
                    % (SELECT count(*) FROM documents) AS VARCHAR) AS article_id,
               CASE e.event_type WHEN 'signup' THEN 'post' WHEN 'purchase' THEN 'post'
                    WHEN 'click' THEN 'retweet' WHEN 'view' THEN 'reply' WHEN 'error' THEN 'mention' END AS kind,
               e.ts AS ts
        FROM events e"""),
    "raw_articles": (("articles", "tweets"), """
        SELECT a.news_id AS id, coalesce(r.tweet_ids, '') AS tweet_ids
        FROM articles a LEFT JOIN (
            SELECT article_id,
                   substr(string_agg([chr(9), ',', ';', '|', ' '][(tweet_id % 5) + 1] || CAST(tweet_id AS VARCHAR), ''
                                     ORDER BY tweet_id), 2) AS tweet_ids
            FROM tweets GROUP BY article_id) r ON a.news_id = r.article_id"""),
    "interactions": (("tweets",), """
        SELECT src, dst, kind, tweet_id, article_id, ts FROM (
            SELECT user_id AS src,
                   last_value(CASE WHEN kind = 'post' THEN user_id END IGNORE NULLS) OVER (
                       PARTITION BY article_id ORDER BY ts, tweet_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dst,
                   kind, tweet_id, article_id, ts
            FROM tweets) x
        WHERE kind <> 'post' AND dst IS NOT NULL AND dst <> src"""),
    "vectors": ((), """
        SELECT CAST(vec_id AS VARCHAR) AS news_id, embedding FROM embeddings"""),
}


def with_views(body: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """Prefix ``body`` with the CTEs it (transitively) mentions, in dependency order."""
    defs = dict(VIEWS)
    if extra:
        defs.update(extra)
    order: list[str] = []

    def mentioned(text: str) -> list[str]:
        import re
        return [n for n in defs if re.search(rf"\b{n}\b", text)]

    def visit(name: str, stack: tuple = ()):
        if name in order or name in stack:
            return
        deps, text = defs[name]
        for d in list(deps) + mentioned(text):
            if d != name:
                visit(d, stack + (name,))
        order.append(name)

    for n in mentioned(body):
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({defs[n][1]})" for n in order)
    return f"WITH {ctes}\n{body}"
