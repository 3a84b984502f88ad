"""Text of a tree of elements, from markup, in Columns: nodes as intervals, pruned subtrees, limits in document order.

Markup is cut into tags and texts. Tags of one name are matched as brackets; a
stray closing tag is nothing, and an element that nothing closes holds nothing:
what follows belongs to the element around it. Depth and pruning are running
sums over the intervals, so no stack is kept and crossing elements do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Limits of a walk. Fixed values.
NODES, DEPTH, CHARS = 2500, 40, 200_000
#: Comments, raw elements, declarations, tags and texts; a lone < is text.
TOKEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)|<[!?][^>]*(?:>|$)|</?[a-z][^>]*(?:>|$)|[^<]+|<"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements that aren't shown, and attributes that make one so.
UNSEEN = ("head", "noscript", "template", "svg", "select")
SECURE = r"(?i)\s(?:hidden|aria-hidden\s*=\s*[\"']?true|type\s*=\s*[\"']?password)(?:[\s/>\"']|$)"
LABEL = r"(?i)\s(?:alt|title|aria-label)\s*=\s*\"([^\"]*)\""
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain(text: Column) -> Column:
    """Entities resolved, white space as one blank, none at the ends."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def nodes(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """id, pos, kind (open, leaf), name, depth, pruned, text of each node of each page, in order of pos.

    open: an element with its label, if it has one; leaf: a text. depth counts the elements around.
    """
    t = pages.select(F.col(id_).alias("id"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    name = F.lower(F.regexp_extract("token", r"(?is)^</?([a-z][a-z0-9:-]*)", 1))
    raw = F.col("token").rlike(r"(?is)^<(?:!|\?|script\b|style\b)")
    kind = F.when(raw, "none").when(F.col("name") == "", "leaf").when(F.col("token").startswith("</"), "close").when(F.col("name").isin(*VOID) | F.col("token").endswith("/>"), "void").otherwise("open")
    t = t.withColumn("name", name).withColumn("kind", kind).where("kind <> 'none'")
    # Brackets of one name: a running count, lifted wherever stray closings would take it below zero.
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    same = W.partitionBy("id", "name").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("step", step).withColumn("sum", F.sum("step").over(same)).withColumn("low", F.least(F.min("sum").over(same), F.lit(0)))
    stray = (F.col("kind") == "close") & (F.col("sum") == F.col("low")) & (F.col("low") < F.coalesce(F.lag("low").over(W.partitionBy("id", "name").orderBy("pos")), F.lit(0)))
    t = t.withColumn("stray", stray).withColumn("level", F.col("sum") - F.col("low") + F.when(F.col("kind") == "close", 1).otherwise(0))
    bracket = W.partitionBy("id", "name", "level", F.col("kind").isin("open", "close") & ~F.col("stray")).orderBy("pos")
    closed = (F.col("kind") == "open") & (F.lead("kind").over(bracket) == "close")
    closes = (F.col("kind") == "close") & ~F.col("stray") & (F.lag("kind").over(bracket) == "open")
    t = t.withColumn("edge", F.when(closed, 1).when(closes, -1).otherwise(0))
    hidden = (F.col("name").isin(*UNSEEN) | F.col("token").rlike(SECURE)) & F.col("kind").isin("open", "void")
    t = t.withColumn("hidden", hidden)
    # A pruned element's closing tag takes away what its opening tag added.
    whole = W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    shuts = (F.col("edge") == -1) & F.lag("hidden").over(bracket)
    t = t.withColumn("veil", F.when((F.col("edge") == 1) & F.col("hidden"), 1).when(shuts, -1).otherwise(0))
    t = t.withColumn("depth", F.sum("edge").over(whole) - F.when(F.col("edge") == 1, 1).otherwise(0)).withColumn("pruned", (F.sum("veil").over(whole) > 0) | F.col("hidden"))
    label = F.when(F.col("kind") == "leaf", F.col("token")).otherwise(F.regexp_extract("token", LABEL, 1))
    return t.where(F.col("kind").isin("open", "void", "leaf")).select("id", "pos", F.when(F.col("kind") == "leaf", "leaf").otherwise("open").alias("kind"), "name", F.col("depth").cast("int").alias("depth"), "pruned", plain(label).alias("text"))


def tree_text(pages: DataFrame, id_: str = "page_id", html: str = "html", most: int = NODES, depth: int = DEPTH, chars: int = CHARS) -> DataFrame:
    """id, n_nodes, text of each page: labels and texts of the first `most` nodes not pruned and no deeper than `depth`, a line each, `chars` characters at most."""
    seen = nodes(pages, id_, html).where(~F.col("pruned") & (F.col("depth") <= depth)).where("kind = 'open' OR text <> ''")
    order = W.partitionBy("id").orderBy("pos")
    seen = seen.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    before = F.coalesce(F.sum(F.when(F.col("text") != "", F.length("text") + 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = seen.withColumn("text", F.substring("text", F.lit(1), F.greatest(F.lit(chars) - before, F.lit(0)).cast("int")))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("nth", "text")))), lambda x: x["text"])  # `most` at most
    text = cut.groupBy("id").agg(F.count("*").alias("n_nodes"), F.array_join(lines, "\n").alias("text"))
    return pages.select(F.col(id_).alias("id")).join(text, "id", "left").select("id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("text", F.lit("")).alias("text"))


def tree_sql(pages: str = "pages", id_: str = "page_id", most: int = NODES, depth: int = DEPTH, chars: int = CHARS) -> str:
    """DuckDB SQL of tree_text."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    names = lambda xs: ", ".join(map(q, xs))
    text = "x"
    for entity, char in ENTITIES:
        text = f"replace({text}, {q(entity)}, {q(char)})"
    return f"""WITH t0 AS (SELECT {id_} AS id, regexp_extract_all(coalesce(html, ''), {q(TOKEN)}) AS ts FROM {pages}),
      t1 AS (SELECT id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM t0),
      t2 AS (SELECT *, lower(regexp_extract(token, '(?is)^</?([a-z][a-z0-9:-]*)', 1)) AS name FROM t1 WHERE NOT regexp_matches(token, '(?is)^<(?:!|\\?|script\\b|style\\b)')),
      t3 AS (SELECT *, CASE WHEN name = '' THEN 'leaf' WHEN starts_with(token, '</') THEN 'close' WHEN name IN ({names(VOID)}) OR ends_with(token, '/>') THEN 'void' ELSE 'open' END AS kind FROM t2),
      t4 AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY id, name ORDER BY pos) AS s FROM t3),
      t5 AS (SELECT *, least(min(s) OVER (PARTITION BY id, name ORDER BY pos), 0) AS low FROM t4),
      t6 AS (SELECT *, kind = 'close' AND s = low AND low < coalesce(lag(low) OVER (PARTITION BY id, name ORDER BY pos), 0) AS stray, s - low + CASE kind WHEN 'close' THEN 1 ELSE 0 END AS level,
        (name IN ({names(UNSEEN)}) OR regexp_matches(token, {q(SECURE)})) AND kind IN ('open', 'void') AS hidden FROM t5),
      t7 AS (SELECT *, CASE WHEN kind = 'open' AND lead(kind) OVER b = 'close' THEN 1 WHEN kind = 'close' AND NOT stray AND lag(kind) OVER b = 'open' THEN -1 ELSE 0 END AS edge, lag(hidden) OVER b AS opener
        FROM t6 WINDOW b AS (PARTITION BY id, name, level, kind IN ('open', 'close') AND NOT stray ORDER BY pos)),
      t8 AS (SELECT *, sum(edge) OVER w - CASE WHEN edge = 1 THEN 1 ELSE 0 END AS depth, sum(CASE WHEN edge = 1 AND hidden THEN 1 WHEN edge = -1 AND opener THEN -1 ELSE 0 END) OVER w > 0 OR hidden AS pruned FROM t7 WINDOW w AS (PARTITION BY id ORDER BY pos)),
      t9 AS (SELECT id, pos, kind, depth, pruned, CASE WHEN kind = 'leaf' THEN token ELSE regexp_extract(token, {q(LABEL)}, 1) END AS x FROM t8 WHERE kind <> 'close'),
      ta AS (SELECT *, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS line FROM t9),
      tb AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth FROM ta WHERE NOT pruned AND depth <= {depth} AND (kind <> 'leaf' OR line <> '') QUALIFY nth <= {most}),
      tc AS (SELECT *, coalesce(sum(CASE WHEN line <> '' THEN length(line) + 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tb),
      td AS (SELECT id, nth, CASE WHEN before < {chars} THEN substr(line, 1, CAST({chars} - before AS BIGINT)) ELSE '' END AS line FROM tc),
      te AS (SELECT id, count(*) AS n_nodes, coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE line <> ''), '') AS text FROM td GROUP BY id)
      SELECT p.{id_} AS id, coalesce(n_nodes, 0) AS n_nodes, coalesce(text, '') AS text FROM {pages} p LEFT JOIN te ON te.id = p.{id_}"""
