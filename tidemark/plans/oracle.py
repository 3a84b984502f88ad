"""DuckDB SQL with the rows of each registered query. Literal rows and fixed values come from the queries' own modules."""

from __future__ import annotations

from tidemark.functions.text import MAX_TERMS, SPINNERS, STOPWORDS, query_term_list
from tidemark.operators import chunk, exclude, filing, markup, neardup, redact
from tidemark.plans import queries as q
from tidemark.plans.derived import CHUNKS_SQL, CONTEXTS_SQL, DRAFTS_SQL, EVENTS_SQL, SHARD_SQL


def lit(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({names})"


NORM = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
FOLDED = "strip_accents(lower(text))"
LO, HI = (f"TIMESTAMP '{x}'" for x in q.RANGE)
ELO, EHI = (f"TIMESTAMP '{x}'" for x in q.EVENT_RANGE)
STRATEGY = "CASE " + " ".join(f"WHEN bundle = {lit(b)} THEN {lit(s)}" for b, s in exclude.STRATEGIES) + " ELSE 'axThenOCR' END"
BUNDLE = "CASE " + " ".join(f"WHEN doc_id % 13 = {i} THEN {lit(b)}" for i, (b, _) in enumerate(exclude.STRATEGIES)) + " ELSE 'com.example.other' END"
STRATEGIES_SQL = f"""b AS (SELECT *, {BUNDLE} AS bundle FROM documents),
s AS (SELECT doc_id, bundle, {STRATEGY} AS strategy, CASE WHEN doc_id % 3 = 0 THEN lang ELSE text END AS ax, text || chr(10) || source AS ocr FROM b),
n AS (SELECT *, CASE strategy WHEN 'axOnly' THEN false WHEN 'ocrOnly' THEN true ELSE length(trim(regexp_replace(coalesce(ax, ''), '\\s+', ' ', 'g'))) <= 16 END AS needs FROM s)"""
SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
TOKENS = "CAST(ceil(len(" + WORDS + ") * CAST(1.3 AS DOUBLE)) AS INT)"


def _redact_tokens() -> str:
    steps, last = [f"r0 AS (SELECT -id AS doc_id, text, 0 AS f FROM {values(q.SECRETS, 'id, text')} UNION ALL SELECT doc_id, text, 0 FROM documents)"], "r0"
    for i, (name, flag, pattern) in enumerate(redact.RULES, 1):
        pattern = pattern.replace("{0,8192}?", "*?")  # the engine's repeat limit is 1,000
        hit = f"coalesce(regexp_matches(text, {lit(pattern)}), false)"
        steps.append(f"r{i} AS (SELECT doc_id, CASE WHEN {hit} THEN regexp_replace(text, {lit(pattern)}, '[redacted:{name}]', 'g') ELSE text END AS text, CASE WHEN {hit} THEN f | {flag} ELSE f END AS f FROM {last})")
        last = f"r{i}"
    return f"WITH {', '.join(steps)} SELECT doc_id, sha256(text) AS hash, f AS redaction_flags FROM {last}"


def _event_time() -> str:
    from tidemark.functions import dates

    months = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dates.MONTHS.items()) + " END"
    days = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dates.WEEKDAYS.items()) + " END"
    part = lambda p, g: f"nullif(regexp_extract(text, {lit(p)}, {g}), '')"
    at = lambda p: f"CASE WHEN regexp_matches(text, {lit(p)}) THEN length(regexp_extract(text, {lit('(?s)^(.*?)(?:' + p + ')')}, 1)) + 1 ELSE 0 END"
    day = lambda y, m, d: f"try_cast(printf('%04d-%02d-%02d', CAST({y} AS INT), CAST({m} AS INT), CAST({d} AS INT)) AS DATE)"

    def named(p: str, mg: int, dg: int) -> str:
        m, d, y = months.format(f"lower({part(p, mg)})"), part(p, dg), part(p, 3)
        this = day(2026, m, d)
        return f"CASE WHEN {y} IS NOT NULL THEN {day(y, m, d)} WHEN {this} < DATE '2026-01-05' THEN {day(2027, m, d)} ELSE {this} END"

    rel = f"lower({part(dates.RELATIVE, 1)})"
    qual = f"lower({part(dates.WEEKDAY, 1)})"
    delta = f"(({days.format(f'lower({part(dates.WEEKDAY, 2)})')}) - 2 + 7) % 7"
    rows = [
        (dates.ISO_DATE, 0, day(part(dates.ISO_DATE, 1), part(dates.ISO_DATE, 2), part(dates.ISO_DATE, 3))),
        (dates.MONTH_DAY, 1, named(dates.MONTH_DAY, 1, 2)), (dates.DAY_MONTH, 1, named(dates.DAY_MONTH, 2, 1)),
        (dates.RELATIVE, 2, f"DATE '2026-01-05' + CASE WHEN {rel} = 'yesterday' THEN -1 WHEN {rel} = 'today' THEN 0 WHEN {rel} IS NOT NULL THEN 1 END"),
        (dates.WEEKDAY, 3, f"DATE '2026-01-05' + CAST({delta} + CASE {qual} WHEN 'next' THEN 7 WHEN 'last' THEN -7 ELSE 0 END AS INT)"),
    ]
    found = " UNION ALL ".join(f"SELECT doc_id, {at(p)} AS loc, {prio} AS prio, CAST({d} AS DATE) AS day FROM t" for p, prio, d in rows)
    return f"""WITH t AS (SELECT -id AS doc_id, text FROM {values(q.DATED, 'id, text')} UNION ALL SELECT doc_id, text FROM documents),
      f AS ({found}), best AS (SELECT doc_id, arg_min(day, loc * 10 + prio) AS day FROM f WHERE loc > 0 AND day IS NOT NULL GROUP BY doc_id)
      SELECT t.doc_id, CAST(best.day AS VARCHAR) AS day FROM t LEFT JOIN best USING (doc_id)"""


def _minhash() -> str:
    pairs = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(neardup.coefficients()))
    return f"""WITH w AS (SELECT item_id, {WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
      s AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
      b AS (SELECT item_id, g, list_transform(range(0, CAST(octet_length(encode(g)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(g)), CAST(2 * i + 1 AS BIGINT), 2) AS INT)) AS bytes FROM s),
      x AS (SELECT item_id, list_reduce(list_transform(bytes, lambda y: CAST(y AS BIGINT)), lambda h, y: (xor(h, y) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS x FROM b)
      SELECT item_id, k, CAST(min((CAST(a AS HUGEINT) * x + b) % 4294967291) AS BIGINT) AS value FROM x, (VALUES {pairs}) c(k, a, b) GROUP BY item_id, k"""


def _index() -> str:
    return f"""{CHUNKS_SQL},
      toks AS (SELECT shard, chunk_id, {TERMS.format(FOLDED).replace("lower(strip", "(strip")} AS terms FROM chunks),
      words AS (SELECT shard, chunk_id, len(terms) AS len, unnest(terms) AS term FROM toks),
      idx AS (SELECT shard, chunk_id, len, term, count(*) AS tf FROM words GROUP BY ALL),
      stats AS (SELECT shard, count(*) AS n_chunks, avg(len(terms)) AS avg_len FROM toks GROUP BY shard),
      terms AS (SELECT * FROM (VALUES {", ".join(f"({lit(t)}, {i})" for i, t in enumerate(query_term_list(q.SEARCH)))}) v(term, nth)),
      hits AS (SELECT idx.*, nth FROM idx JOIN terms USING (term)),
      dfs AS (SELECT shard, term, count(*) AS n FROM hits GROUP BY ALL),
      parts AS (SELECT h.shard, chunk_id, nth, CASE WHEN ln((n_chunks - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_chunks - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) END
        * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)) AS part FROM hits h JOIN dfs USING (shard, term) JOIN stats USING (shard)),
      bm AS (SELECT shard, chunk_id, -sum(part ORDER BY nth) AS score FROM parts GROUP BY ALL)"""


def _search(lo: str, hi: str, limit: int, keyword: bool = True, vectors: bool = False) -> str:
    pool = max(5 * limit, 50)
    lists = []
    if keyword:
        lists.append(f"SELECT shard, chunk_id, 1 AS l, row_number() OVER (PARTITION BY shard ORDER BY score, chunk_id) AS r FROM bm JOIN able USING (shard, chunk_id) QUALIFY r <= {pool}")
    lists.append(f"SELECT shard, chunk_id, 2 AS l, row_number() OVER (PARTITION BY shard ORDER BY ts_capture DESC, chunk_id) AS r FROM able QUALIFY r <= {pool}")
    near = weeks = ""
    if vectors:  # in a store, where weeks outside the range aren't read
        weeks = f" AND shard BETWEEN {SHARD_SQL.format(lo)} AND {SHARD_SQL.format(hi)}"
        near = f"""{QUANT}, b AS (SELECT z.vec_id AS chunk_id, ints, CAST(CAST(s AS FLOAT) AS DOUBLE) AS scale FROM z JOIN s USING (vec_id)),
      near AS (SELECT b.chunk_id, list_sum(list_transform(range(1, 65), lambda i: CAST(b.ints[i] * p.ints[i] AS BIGINT))) * b.scale * p.scale AS similarity FROM b, b p WHERE p.chunk_id = 0),
      """
        lists.append(f"SELECT shard, chunk_id, 3 AS l, row_number() OVER (PARTITION BY shard ORDER BY similarity DESC, chunk_id) AS r FROM near JOIN able USING (chunk_id) WHERE similarity >= 0.3 QUALIFY r <= {pool}")
    return f"""{near}able AS (SELECT * FROM chunks WHERE ts_capture BETWEEN {lo} AND {hi}{weeks}), lists AS ({" UNION ALL ".join(lists)}),
      fused AS (SELECT shard, chunk_id, coalesce(1.0::DOUBLE / (60 + max(CASE WHEN l = 1 THEN r END)), 0) + coalesce(1.0::DOUBLE / (60 + max(CASE WHEN l = 2 THEN r END)), 0) + coalesce(1.0::DOUBLE / (60 + max(CASE WHEN l = 3 THEN r END)), 0) AS score FROM lists GROUP BY ALL)"""


def _full(lo: str, hi: str, limit: int, keyword: bool = True, vectors: bool = False) -> str:
    return f"""WITH {_index()}, {_search(lo, hi, limit, keyword, vectors)},
      fe AS (SELECT f.*, episode_id FROM fused f JOIN chunks USING (shard, chunk_id)),
      c1 AS (SELECT *, row_number() OVER (PARTITION BY shard, episode_id ORDER BY score DESC, chunk_id) > 3 AS beyond FROM fe),
      d1 AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY beyond, score DESC, chunk_id) AS place FROM c1 QUALIFY place <= {limit}),
      again AS (SELECT chunk_id, episode_id, CASE WHEN (SELECT count(DISTINCT shard) FROM d1) > 1 THEN 1.0::DOUBLE / (60 + place) ELSE score END AS score FROM d1),
      c2 AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, chunk_id) > 3 AS beyond FROM again)
      SELECT chunk_id, episode_id, round(score, 9) AS score, row_number() OVER (ORDER BY beyond, score DESC, chunk_id) AS place{", 'untrusted_ambient' AS provenance" if vectors else ""} FROM c2 QUALIFY place <= {limit}"""


def _many(lo: str, hi: str, app: str, entity: str) -> str:
    """WITH .. answers(probe, chunk_id, episode_id, score, place): a search with limit 8 for each benchmark item."""
    words = f"""list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2 AND x NOT IN ({", ".join(map(lit, STOPWORDS))}))"""
    return f"""WITH {_index()},
      qs AS (SELECT item_id AS probe, text, CAST({lo} AS TIMESTAMP) AS lo, CAST({hi} AS TIMESTAMP) AS hi, CAST({app} AS VARCHAR) AS app, CAST({entity} AS VARCHAR) AS entity FROM benchmark),
      w AS (SELECT probe, {words} AS w FROM qs), p AS (SELECT probe, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM w), f AS (SELECT probe, term, min(i) AS i FROM p GROUP BY ALL),
      t0 AS (SELECT probe, term, row_number() OVER (PARTITION BY probe ORDER BY i) AS nth FROM f QUALIFY nth <= {MAX_TERMS}), t AS (SELECT probe, strip_accents(term) AS term, min(nth) AS nth FROM t0 GROUP BY ALL),
      reach AS (SELECT qs.*, shard FROM qs, (SELECT DISTINCT shard FROM chunks) WHERE lo IS NULL OR shard BETWEEN {SHARD_SQL.format("lo")} AND {SHARD_SQL.format("hi")}),
      n2 AS (SELECT shard, term, count(*) AS n FROM idx GROUP BY ALL),
      p2 AS (SELECT probe, shard, chunk_id, nth, CASE WHEN ln((n_chunks - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_chunks - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) END
        * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)) AS part FROM idx JOIN t USING (term) JOIN n2 USING (shard, term) JOIN stats USING (shard)),
      sc AS (SELECT probe, shard, chunk_id, -sum(part ORDER BY nth) AS score FROM p2 GROUP BY ALL),
      able2 AS (SELECT probe, c.shard, chunk_id, episode_id, ts_capture, lo FROM chunks c JOIN reach r ON c.shard = r.shard AND (lo IS NULL OR ts_capture BETWEEN lo AND hi) AND (app IS NULL OR app_name = app OR bundle_id = app) AND (entity IS NULL OR list_contains(entity_keys, entity))),
      lists2 AS (SELECT probe, shard, chunk_id, 1 AS l, row_number() OVER (PARTITION BY probe, shard ORDER BY score, chunk_id) AS r FROM sc JOIN able2 USING (probe, shard, chunk_id) QUALIFY r <= 50
        UNION ALL SELECT probe, shard, chunk_id, 2, row_number() OVER (PARTITION BY probe, shard ORDER BY ts_capture DESC, chunk_id) AS r FROM able2 WHERE lo IS NOT NULL OR probe NOT IN (SELECT probe FROM t) QUALIFY r <= 50),
      fe AS (SELECT probe, shard, chunk_id, chunk_id // 10 AS episode_id, coalesce(1.0::DOUBLE / (60 + max(CASE WHEN l = 1 THEN r END)), 0) + coalesce(1.0::DOUBLE / (60 + max(CASE WHEN l = 2 THEN r END)), 0) AS score FROM lists2 GROUP BY ALL),
      c1 AS (SELECT *, row_number() OVER (PARTITION BY probe, shard, episode_id ORDER BY score DESC, chunk_id) > 3 AS beyond FROM fe),
      d1 AS (SELECT *, row_number() OVER (PARTITION BY probe, shard ORDER BY beyond, score DESC, chunk_id) AS place FROM c1 QUALIFY place <= 8),
      m AS (SELECT probe, count(DISTINCT shard) AS shards FROM d1 GROUP BY probe),
      again AS (SELECT probe, chunk_id, episode_id, CASE WHEN shards > 1 THEN 1.0::DOUBLE / (60 + place) ELSE score END AS score FROM d1 JOIN m USING (probe)),
      c2 AS (SELECT *, row_number() OVER (PARTITION BY probe, episode_id ORDER BY score DESC, chunk_id) > 3 AS beyond FROM again),
      answers AS (SELECT probe, chunk_id, episode_id, score, row_number() OVER (PARTITION BY probe ORDER BY beyond, score DESC, chunk_id) AS place FROM c2 QUALIFY place <= 8)"""


QUANT = """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM e),
  s AS (SELECT vec_id, u, list_max(list_transform(u, lambda x: abs(x))) / 127 AS s FROM u),
  z AS (SELECT vec_id, list_transform(u, lambda x: CAST(greatest(-127, least(127, round(x / s))) AS INT)) AS ints FROM s)"""
LUHN = """d AS (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS digits FROM orders)
  SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * CAST(digits[i] AS INT) > 9 THEN 2 * CAST(digits[i] AS INT) - 9 ELSE 2 * CAST(digits[i] AS INT) END ELSE CAST(digits[i] AS INT) END)) % 10 = 0 AS valid FROM d"""


AMBIENT_SQL = f"""WITH m AS (SELECT doc_id // 40 AS sweep, doc_id % 40 AS window_id, lang, CASE WHEN source = 'src1' THEN 'never_capture' WHEN lang = 'de' THEN 'redact' ELSE 'capture' END AS mode FROM documents),
  x AS (SELECT sweep, window_id, mode, CASE WHEN mode = 'redact' THEN '{redact.PLACEHOLDER}' ELSE 'window ' || lang END AS title, CASE mode WHEN 'redact' THEN '{redact.PLACEHOLDER}' WHEN 'capture' THEN lang END AS text, sweep - row_number() OVER (PARTITION BY window_id ORDER BY sweep) AS stretch FROM m),
  y AS (SELECT *, last_value(text IGNORE NULLS) OVER (PARTITION BY window_id, stretch ORDER BY sweep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
  swept AS (SELECT sweep, window_id, mode, title, text, CASE WHEN mode = 'never_capture' THEN 'excluded' WHEN text IS NULL THEN 'nothing' WHEN before IS NOT DISTINCT FROM text THEN 'skip' ELSE 'stored' END AS outcome FROM y)"""


THROTTLE_SQL = """WITH RECURSIVE e AS (SELECT event_type AS client, event_id AS seq, epoch_us(ts) / 1e6 AS at, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
  r AS (SELECT DISTINCT client, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS held, CAST(NULL AS BOOLEAN) AS admitted FROM e
    UNION ALL SELECT s.client, s.seq, s.n, CASE WHEN len(s.live) < 3 THEN list_append(s.live, s.at) ELSE s.live END, len(s.live) < 3
    FROM (SELECT e.*, list_filter(r.held, lambda t: e.at - t < 3600) AS live FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1) s)
  SELECT client, seq, admitted FROM r WHERE n > 0"""
OCR_SQL = f"""WITH RECURSIVE w AS (SELECT l_orderkey AS image, 'w' || l_linenumber AS text, -(CAST(1 AS DOUBLE) - l_linenumber * CAST(0.01 AS DOUBLE)) AS down, CAST(l_partkey % 100 AS DOUBLE) AS place FROM lineitem),
  n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY down, place, text) AS n FROM w),
  r AS (SELECT image, text, down, place, n, down AS anchor, 1 AS line FROM n WHERE n = 1
    UNION ALL SELECT x.image, x.text, x.down, x.place, x.n, CASE WHEN fits THEN x.anchor ELSE x.down END, x.line + CASE WHEN fits THEN 0 ELSE 1 END
    FROM (SELECT n.*, r.anchor, r.line, abs(n.down - r.anchor) <= CAST({exclude.LINE} AS DOUBLE) AS fits FROM r JOIN n ON n.image = r.image AND n.n = r.n + 1) x),
  l AS (SELECT image, line, string_agg(text, ' ' ORDER BY place, text) AS text FROM r GROUP BY image, line)
  SELECT image, string_agg(text, chr(10) ORDER BY line) AS text FROM l GROUP BY image"""


def _cards() -> str:
    digit = "CAST(substr(reverse(c), CAST(i + 1 AS BIGINT), 1) AS INT)"
    luhn = f"list_sum(list_transform(range(0, len(c)), lambda i: CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0"
    ends = ", ".join(f"left(d, {n}), right(d, {n})" for n in (16, 15, 13))
    return f"""WITH d AS (SELECT -doc_id AS doc_id, text FROM {values(q.CARDS, "doc_id, text")} UNION ALL SELECT doc_id, text FROM documents),
      m AS (SELECT doc_id, text, regexp_split_to_array(text, '{redact.CARD}') AS parts, regexp_extract_all(text, '{redact.CARD}') AS runs FROM d),
      g AS (SELECT *, list_transform(list_transform(runs, lambda r: regexp_replace(r, '[^0-9]', '', 'g')), lambda d: CASE WHEN length(d) IN (17, 18) THEN [{ends}] ELSE [d] END) AS ends FROM m),
      v AS (SELECT *, list_transform(ends, lambda e: len(list_filter(e, lambda c: {luhn})) > 0) AS valid FROM g),
      n AS (SELECT doc_id, text, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i > len(runs) THEN '' WHEN valid[i] THEN '{redact.mask("creditCard")}' ELSE runs[i] END), '') AS masked FROM v)
      SELECT doc_id, sha256(masked) AS hash, CASE WHEN masked <> text THEN {redact.CREDIT_CARD} ELSE 0 END AS redaction_flags FROM n"""


def _chunks() -> str:
    """Sentences and, of sentences above the most, stretches of as many words as fit at two tokens a word; then greedy packing."""
    most, target = chunk.MOST, chunk.TARGET
    step = most // 2
    return f"""WITH RECURSIVE t AS (SELECT doc_id, unnest({SENTENCES.format(NORM)}) AS s, generate_subscripts({SENTENCES.format(NORM)}, 1) AS nth FROM documents),
      w AS (SELECT doc_id, nth, s, {WORDS.format("s")} AS w, {TOKENS.format("s")} AS tokens FROM t),
      x AS (SELECT doc_id, nth, unnest(CASE WHEN tokens <= {most} THEN [s] ELSE list_transform(range(0, len(w), {step}), lambda i: array_to_string(w[i + 1:i + {step}], ' ')) END) AS text,
        unnest(CASE WHEN tokens <= {most} THEN [CAST(0 AS BIGINT)] ELSE range(0, len(w), {step}) END) AS part FROM w),
      p AS (SELECT doc_id, text, {TOKENS.format("text")} AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY nth, part) AS n FROM x),
      r AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS next FROM p
        UNION ALL SELECT doc_id, n, CASE WHEN now >= {target} THEN 0 ELSE now END, place, place + CASE WHEN now >= {target} THEN 1 ELSE 0 END
        FROM (SELECT p.doc_id, p.n, CAST(CASE WHEN r.held > 0 AND r.held + p.tokens > {most} THEN p.tokens ELSE r.held + p.tokens END AS BIGINT) AS now,
          r.next + CASE WHEN r.held > 0 AND r.held + p.tokens > {most} THEN 1 ELSE 0 END AS place FROM r JOIN p ON p.doc_id = r.doc_id AND p.n = r.n + 1) s)
      SELECT doc_id, CAST(place AS INT) AS ordinal, sha256(string_agg(text, ' ' ORDER BY n)) AS hash, CAST(sum(tokens) AS INT) AS token_count FROM r JOIN p USING (doc_id, n) GROUP BY doc_id, place"""


def _extracts(url: str) -> str:
    keys = ", ".join(f"({i}, '{key}', '{name}', '{when}')" for i, (key, (name, when)) in enumerate(filing.FIELDS.items()))
    known = ", ".join(f"'{key}'" for key in filing.FIELDS)
    instant = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:?\d\d)"
    return f"""WITH p AS (SELECT -id AS id, payload FROM {values(q.EXTRACTS, "id, payload")} UNION ALL SELECT item_id, CAST(json_object('log_entries', json_array(json_object('text', text))) AS VARCHAR) FROM benchmark),
      j AS (SELECT row_number() OVER () AS row, id, payload, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM p),
      o AS (SELECT * FROM j WHERE json_type(j) = 'OBJECT'),
      e AS (SELECT row, list_min(list_filter(json_keys(j), lambda k: k NOT IN ({known}))) AS extra FROM o),
      f AS (SELECT row, nth, name, stamp, json_extract(j, '$.' || key) AS list FROM o, (VALUES {keys}) v(nth, key, name, stamp)),
      i AS (SELECT row, nth, name, stamp, unnest(json_extract(list, '$[*]')) AS item, generate_subscripts(json_extract(list, '$[*]'), 1) AS place FROM f WHERE json_type(list) = 'ARRAY'),
      c AS (SELECT row, nth, place, item ->> ('$.' || name) AS text, json_type(item) <> 'OBJECT' OR json_type(item, '$.' || name) IS DISTINCT FROM 'VARCHAR'
        OR (coalesce(json_type(item, '$.' || stamp), 'NULL') <> 'NULL' AND NOT (json_type(item, '$.' || stamp) = 'VARCHAR' AND regexp_full_match(item ->> ('$.' || stamp), '{instant}'))) AS bad FROM i),
      k AS (SELECT row, nth, place, bad, CASE WHEN regexp_full_match(text, '\\s*') THEN 'empty text' WHEN length(text) > {filing.MOST_TEXT} THEN 'text too long' WHEN {url.format("text")} THEN 'URL in field' END AS reason FROM c),
      s AS (SELECT row, bool_or(bad) AS bad, arg_min(reason, struct_pack(a := nth, b := place)) FILTER (WHERE reason IS NOT NULL) AS reason FROM k GROUP BY row),
      l AS (SELECT row, bool_or(list IS NOT NULL AND json_type(list) <> 'ARRAY') AS bad, max(json_array_length(list)) > {filing.MOST_ITEMS} AS many FROM f GROUP BY row)
      SELECT id, CASE WHEN o.row IS NULL THEN 'not a JSON object' WHEN extra IS NOT NULL THEN 'unknown field: ' || extra WHEN {url.format("j.payload")} THEN 'URL in payload'
        WHEN l.bad OR s.bad THEN 'malformed schema' WHEN many THEN 'too many items' ELSE s.reason END AS reason
      FROM j LEFT JOIN (SELECT row FROM o) o USING (row) LEFT JOIN e USING (row) LEFT JOIN s USING (row) LEFT JOIN l USING (row)"""

def oracle_sql() -> dict[str, str]:
    contexts = f"WITH {CONTEXTS_SQL}"
    shards = f"WITH s AS (SELECT DISTINCT {SHARD_SQL.format('ts')} AS shard, CAST(date_trunc('week', ts) AS TIMESTAMP) AS lo FROM events), r AS (SELECT shard, lo, lo + INTERVAL 7 DAY AS hi FROM s)"
    url = "regexp_matches({0}, '(?i)(https?://|www\\.|\\bdata:[^\\s]|\\bjavascript:|\\bfile:/|!\\[|\\]\\()')"
    role = "CASE role WHEN 'user' THEN 'user_input' WHEN 'system' THEN 'system' ELSE 'untrusted_ambient' END"
    out = {
        "normalize_hash": f"SELECT doc_id, length(n) AS n_chars_norm, sha256(n) AS hash FROM (SELECT doc_id, {NORM.replace('text', 'substr(text, 1, 200000)')} AS n FROM documents)",
        "title_normalize": f"{contexts} SELECT event_id, nullif(trim(regexp_replace(regexp_replace('⠋ ◐ ' || title || CASE WHEN event_id % 2 = 0 THEN '  ▄' ELSE '' END, '{SPINNERS}', '', 'g'), '\\s+', ' ', 'g')), '') AS title, CAST(NULL AS VARCHAR) AS nothing FROM app_contexts",
        "shard_id": f"SELECT event_id, {SHARD_SQL.format('ts')} AS shard FROM events",
        "shard_range": f"{shards} SELECT shard, lo, hi FROM r",
        "shards_intersecting": f"{shards} SELECT shard FROM r WHERE lo <= {EHI} AND hi > {ELO}",
        "droppable_shards": f"{shards} SELECT shard FROM r WHERE hi <= {EHI}",
        "external_key": f"WITH {DRAFTS_SQL} SELECT id, external_key FROM drafts",
        "exclusion_mode": f"{contexts} SELECT event_id, CASE WHEN lower(bundle) = 'com.example.purchase' OR regexp_matches(bundle || chr(10) || app || chr(10) || title || chr(10), '(?i)click\\nuser \\d+7\\n') THEN 'never_capture' WHEN contains(lower(title), 'user 1') THEN 'redact' ELSE 'capture' END AS mode FROM app_contexts",
        "capability_strategy": f"WITH {STRATEGIES_SQL} SELECT doc_id, bundle, strategy FROM n",
        "ocr_fallback": f"WITH {STRATEGIES_SQL} SELECT doc_id, needs AS needs_ocr FROM n",
        "layered_choice": f"WITH {STRATEGIES_SQL}, c AS (SELECT *, strategy = 'ocrOnly' OR (NOT (doc_id % 7 = 0) AND needs AND length(coalesce(ocr, '')) > length(coalesce(ax, ''))) AS o FROM n) SELECT doc_id, CASE WHEN o THEN 'ocr' ELSE 'ax' END AS source, length(CASE WHEN o THEN ocr ELSE ax END) AS n_text FROM c",
        "ocr_budget": f"WITH {STRATEGIES_SQL} SELECT doc_id, needs AND row_number() OVER (PARTITION BY doc_id // 20, needs ORDER BY doc_id) <= 4 AS may_ocr FROM n",
        "redact_tokens": _redact_tokens(),
        "luhn": f"WITH {LUHN}",
        "sentence_split": f"WITH s AS (SELECT doc_id, {SENTENCES.format(NORM)} AS s FROM documents) SELECT doc_id, generate_subscripts(s, 1) - 1 AS nth, unnest(s) AS sentence FROM s",
        "token_estimate": f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents",
        "event_time": _event_time(),
        "redact_cards": _cards(),
        "chunk_pack": _chunks(),
        "ocr_assemble": OCR_SQL,
        "throttle": THROTTLE_SQL,
        "extract_validate": _extracts(url),
        "exact_dedup": f"WITH {EVENTS_SQL} SELECT min(event_id) AS event_id, sha256({NORM}) AS hash FROM capture_events GROUP BY 2",
        "hourly_volume": "SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, count(*) AS n_rows, CAST(sum(length(props)) AS BIGINT) AS n_chars FROM events GROUP BY 1",
        "volume_stats": f"WITH {EVENTS_SQL}, e AS (SELECT length(text) AS n, row_number() OVER (PARTITION BY sha256({NORM}) ORDER BY event_id) = 1 AS f FROM capture_events) SELECT count(*) AS produced, CAST(count(*) FILTER (WHERE f) AS BIGINT) AS stored, CAST(count(*) FILTER (WHERE NOT f) AS BIGINT) AS exact_skips, CAST(sum(n) AS BIGINT) AS raw_chars, CAST(sum(n) FILTER (WHERE f) AS BIGINT) AS stored_chars FROM e",
        "minhash_signature": _minhash(),
        "hash_embedding": f"""WITH t AS (SELECT item_id, {TERMS.format("text")} AS w FROM benchmark),
          f AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || chr(31) || w[i + 1]))) AS f FROM t),
          b AS (SELECT item_id, list_reduce(list_transform(range(0, CAST(octet_length(encode(f)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2) AS INT)), lambda h, y: (xor(h, y) * 435) & 511, 293) AS bucket FROM f),
          c AS (SELECT item_id, bucket, count(*) AS n FROM b GROUP BY ALL)
          SELECT item_id, bucket, round(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY item_id) AS DOUBLE)), 9) AS weight FROM c""",
        "quantize_int8": f"WITH {QUANT} SELECT vec_id, generate_subscripts(ints, 1) - 1 AS i, unnest(ints) AS x FROM z",
        "knn_topk": f"""WITH {QUANT}, b AS (SELECT z.vec_id, ints, CAST(CAST(s AS FLOAT) AS DOUBLE) AS scale FROM z JOIN s USING (vec_id)),
          n AS (SELECT p.vec_id AS probe, b.vec_id, p.scale AS own, b.scale, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST(b.ints[i] * p.ints[i] AS BIGINT))) AS BIGINT) AS dot FROM b JOIN b p ON p.vec_id % 100 = 0 AND p.vec_id <> b.vec_id)
          SELECT probe, vec_id, dot, row_number() OVER (PARTITION BY probe ORDER BY dot * scale * own DESC, vec_id) AS place FROM n QUALIFY place <= 10""",
        "knn_lists": "SELECT count(*) FILTER (WHERE vec_id % 100 = 0) AS probes, true AS found FROM embeddings",
        "tree_text": f"SELECT id, n_nodes, length(text) AS n_text, sha256(text) AS hash FROM ({markup.tree_sql()})",
        "gap_admission": """WITH RECURSIVE e AS (SELECT event_type AS client, epoch_us(ts) AS us, min(event_id) AS event_id FROM events GROUP BY event_type, epoch_us(ts)),
          a AS (SELECT client, min(us) AS us FROM e GROUP BY client UNION ALL (SELECT a.client, min(e.us) AS us FROM a JOIN e ON e.client = a.client AND e.us >= a.us + 21600000000 GROUP BY a.client))
          SELECT client, event_id FROM a JOIN e USING (client, us)""",
        "unembedded_anti": f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT doc_id FROM labels)",
        "vector_upsert_latest": "SELECT user_id AS chunk_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1",
        "query_terms": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2 AND x NOT IN ({", ".join(map(lit, STOPWORDS))})) AS w FROM documents),
          p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM w), f AS (SELECT doc_id, term, min(i) AS i FROM p GROUP BY ALL)
          SELECT doc_id, term, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS nth FROM f QUALIFY nth < {MAX_TERMS}""",
        "bm25_topk": f"WITH {_index()} SELECT chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score, chunk_id LIMIT 50",
        "bm25_topk_blocks": f"WITH {_index()} SELECT chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score, chunk_id LIMIT 10",
        "recency_topk": f"WITH {CHUNKS_SQL} SELECT shard, chunk_id, row_number() OVER (PARTITION BY shard ORDER BY ts_capture DESC, chunk_id) AS rank FROM chunks QUALIFY rank <= 50",
        "filter_time_app_entity": f"WITH {CHUNKS_SQL} SELECT chunk_id, ts_capture FROM chunks WHERE ts_capture BETWEEN {LO} AND {HI} AND (app_name = 'src0' OR bundle_id = 'src0') AND list_contains(entity_keys, 'en')",
        "rrf_fuse": f"WITH {_index()}, {_search(LO, HI, 8)} SELECT shard, chunk_id, round(score, 9) AS score FROM fused",
        "diversify": f"WITH {CHUNKS_SQL}, c AS (SELECT shard, chunk_id, chunk_id % 97 AS score, row_number() OVER (PARTITION BY shard, episode_id ORDER BY chunk_id % 97 DESC, chunk_id) > 3 AS beyond FROM chunks) SELECT shard, chunk_id, row_number() OVER (PARTITION BY shard ORDER BY beyond, score DESC, chunk_id) AS place FROM c QUALIFY place <= 20",
        "hybrid_search": _full("TIMESTAMP '2026-01-05 00:00:00'", "TIMESTAMP '2026-01-11 23:00:00'", 8),
        "cross_shard_search": _full(LO, HI, 20),
        "recent_activity": _full(LO, HI, 12, False),
        "recall_at_3": f"""{_many("NULL", "NULL", "NULL", "NULL")},
          held AS (SELECT item_id AS probe, chunk_id FROM benchmark b JOIN chunks c ON contains(c.text, b.text) WHERE item_id IN (SELECT probe FROM t)),
          z AS (SELECT DISTINCT probe FROM held), hit AS (SELECT DISTINCT probe FROM answers JOIN held USING (probe, chunk_id) WHERE place <= 3)
          SELECT count(*) AS probes, CAST(count(hit.probe) AS BIGINT) AS hits, count(hit.probe) / CAST(count(*) AS DOUBLE) AS recall FROM z LEFT JOIN hit USING (probe)""",
        "search_table": f"""{_many(f"CASE WHEN item_id % 4 = 1 THEN {LO} END", f"CASE WHEN item_id % 4 = 1 THEN {HI} END", "CASE WHEN item_id % 4 = 2 THEN 'src0' END", "CASE WHEN item_id % 4 = 3 THEN 'en' END")}
          SELECT probe, chunk_id, episode_id, round(score, 9) AS score, place, 'untrusted_ambient' AS provenance FROM answers""",
        "store_search": _full(LO, HI, 20, vectors=True),
        "sessions_idle": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 43200 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS ts_start, max(ts) AS ts_end, count(*) AS n_events FROM s GROUP BY 1, 2",
        "sessions_idle_global": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 300 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) AS session FROM g) SELECT CAST(session AS BIGINT) AS session, min(ts) AS ts_start, max(ts) AS ts_end, count(*) AS n_events FROM s GROUP BY 1",
        "context_episodes": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 43200 SECOND OR lag(ts) OVER w IS NULL OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS episode FROM g) SELECT user_id, CAST(episode AS BIGINT) AS episode, min(ts) AS ts_start, max(ts) AS ts_end, count(*) AS n FROM s GROUP BY 1, 2",
        "consecutive_dedup": "SELECT event_id, user_id, event_type AS app FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)",
        "sweep_dedup": "WITH e AS (SELECT doc_id % 40 AS window_id, doc_id // 40 AS sweep, lang FROM documents) SELECT sweep, window_id, NOT coalesce(lag(sweep) OVER w = sweep - 1 AND lag(lang) OVER w = lang, false) AS stored FROM e WINDOW w AS (PARTITION BY window_id ORDER BY sweep)",
        "capture_stats": """WITH k AS (SELECT user_id, ts, event_id, event_id % 7 = 0 AS clip, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM events),
          e AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS episode FROM k),
          g AS (SELECT user_id, episode, arg_min(clip, (ts, event_id)) AS first_clip, count(*) FILTER (WHERE clip) AS clips FROM e GROUP BY ALL)
          SELECT count(*) AS episodes_opened, count(*) - count(DISTINCT user_id) AS episodes_closed, count(*) FILTER (WHERE NOT first_clip) AS screen_events, count(*) FILTER (WHERE clips > 0) AS clipboard_events,
            CAST(sum(greatest(clips - 1, 0)) AS BIGINT) AS dedup_skips, count(*) FILTER (WHERE NOT first_clip) AS provider_calls, CAST(0 AS BIGINT) AS idle_provider_calls FROM g""",
        "ambient_sweep": f"{AMBIENT_SQL} SELECT sweep, window_id, mode, title, text, outcome FROM swept",
        "sweep_stats": f"{AMBIENT_SQL} SELECT count(*) FILTER (WHERE outcome = 'stored') AS ambient_episodes, count(*) FILTER (WHERE outcome = 'stored') AS ambient_events, count(*) FILTER (WHERE mode = 'capture') AS ambient_provider_calls, count(*) FILTER (WHERE outcome = 'skip') AS ambient_dedup_skips FROM swept",
        "sweep_log": f"{AMBIENT_SQL} SELECT sweep, window_id, step, kind, title, CASE WHEN kind = 'event' THEN text END AS text FROM swept, (VALUES (0::BIGINT, 'open'), (1, 'event'), (2, 'close')) v(step, kind) WHERE outcome = 'stored'",
        "ambient_choice": f"""WITH {STRATEGIES_SQL}, c AS (SELECT *, doc_id % 4 <> 0 AND ocr IS NOT NULL AS has, length({NORM.replace("text", "coalesce(ocr, '')")}) > length({NORM.replace("text", "coalesce(ax, '')")}) AS longer FROM n),
          x AS (SELECT *, CASE WHEN strategy = 'ocrOnly' THEN CASE WHEN has THEN 'ocr' END WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 7 <> 0 AND needs AND has AND longer THEN 'ocr' WHEN ax IS NOT NULL THEN 'ax' END AS source FROM c)
          SELECT doc_id, source, length(CASE source WHEN 'ocr' THEN ocr WHEN 'ax' THEN ax END) AS n_text FROM x""",
        "sweep_plan": f"""WITH w AS (SELECT p_partkey % 20 AS sweep, p_partkey AS window_id, p_partkey % 37 AS pid, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS title, p_size * 20 * 400 AS area,
          p_partkey % 13 <> 0 AS on_screen, p_partkey % 17 = 0 AS layered, p_partkey % 101 = 0 AS hidden FROM part),
          k AS (SELECT * FROM w WHERE on_screen AND NOT layered AND area >= {exclude.MIN_AREA} AND title IS NOT NULL AND (sweep, pid) NOT IN (SELECT (sweep, pid) FROM w WHERE hidden))
          SELECT sweep, window_id, row_number() OVER (PARTITION BY sweep ORDER BY area DESC, window_id) AS place FROM k QUALIFY place <= {exclude.MAX_WINDOWS}""",
        "sweep_unfocused": f"""WITH w AS (SELECT p_partkey % 20 AS sweep, p_partkey AS window_id, p_partkey % 37 AS pid, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS title, p_size * 20 * 400 AS area,
          p_partkey % 13 <> 0 AS on_screen, p_partkey % 17 = 0 AS layered, p_partkey % 101 = 0 AS hidden FROM part),
          k AS (SELECT * FROM w WHERE on_screen AND NOT layered AND area >= {exclude.MIN_AREA} AND title IS NOT NULL AND (sweep, pid) NOT IN (SELECT (sweep, pid) FROM w WHERE hidden) AND (sweep, pid, title) NOT IN (SELECT (sweep, pid, title) FROM w WHERE window_id % 3 = 0 AND title IS NOT NULL))
          SELECT sweep, window_id, row_number() OVER (PARTITION BY sweep ORDER BY area DESC, window_id) AS place FROM k QUALIFY place <= {exclude.MAX_WINDOWS}""",
        "ledger_since": "SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderstatus AS destination, CAST(floor(o_totalprice) AS BIGINT) AS byte_count, CAST(o_orderkey AS VARCHAR) AS purpose FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderpriority = '1-URGENT'",
        "draft_insert_idempotent": f"WITH {DRAFTS_SQL} SELECT id, external_key FROM drafts WHERE external_key NOT IN (SELECT external_key FROM drafts WHERE id % 10 = 0) QUALIFY row_number() OVER (PARTITION BY external_key ORDER BY created_at, id) = 1",
        "draft_transition": f"""WITH {DRAFTS_SQL}, a AS (SELECT o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 1000000000 ELSE 0 END AS id, ['approve', 'dismiss', 'commit', 'undo'][o_orderkey % 4 + 1] AS action FROM orders),
          r AS (SELECT a.id, action, status, CASE WHEN status IS NULL THEN 'not_found' WHEN (action = 'approve' AND status = 'draft') OR (action = 'dismiss' AND status IN ('draft', 'approved')) OR (action = 'commit' AND status = 'approved') OR (action = 'undo' AND status = 'committed') THEN 'ok' ELSE 'illegal_transition' END AS result FROM a LEFT JOIN drafts d ON d.id = a.id)
          SELECT id, action, result, CASE WHEN result = 'ok' THEN CASE action WHEN 'approve' THEN 'approved' WHEN 'dismiss' THEN 'dismissed' WHEN 'commit' THEN 'committed' ELSE 'undone' END ELSE status END AS new_status FROM r""",
        "drafts_by_status": f"WITH {DRAFTS_SQL} SELECT id, external_key, status FROM drafts WHERE status = 'approved' ORDER BY created_at, id LIMIT 25",
        "pending_drafts": f"WITH {DRAFTS_SQL} SELECT id, external_key FROM drafts WHERE status = 'draft' ORDER BY created_at, id LIMIT 25",
        "url_denylist": f"SELECT page_id, {url.format('url')} AS in_url, {url.format('html')} AS in_html FROM pages",
        "compose_page": "SELECT item_id AS id, CAST(0 AS INT) AS nth, 'heading_2' AS type, 'Log' AS text, 'none' AS checked FROM benchmark UNION ALL SELECT item_id, 1, 'bulleted_list_item', text, 'none' FROM benchmark UNION ALL SELECT * FROM (VALUES (-2, 0, 'paragraph', 'No activity captured for this period.', 'none'), (-1, 0, 'heading_2', 'Commitments', 'none'), (-1, 1, 'to_do', 'ship (due 2026-02-01)', 'false'), (-1, 2, 'to_do', 'call', 'false'), (-1, 3, 'heading_2', 'Log', 'none'), (-1, 4, 'bulleted_list_item', 'met', 'none'), (-1, 5, 'heading_2', 'Reading', 'none'), (-1, 6, 'bulleted_list_item', 'paper', 'none'))",
        "format_results": f"SELECT conv_id, turn, sha256('[' || turn || '] ax · ' || turn || ' · episode ' || substr(CAST(conv_id AS VARCHAR), 1, 8) || chr(10) || CASE WHEN {role} = 'untrusted_ambient' THEN '⟦[' || translate(text, '⟦⟧', '[]') || '⟧' ELSE '[' || translate(text, '⟦⟧', '[]') END) AS hash FROM conversations",
        "provenance_join": f"WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'odd label' ELSE {role} END AS label, text FROM conversations), v AS (SELECT conv_id, turn, min(label) AS label FROM t WHERE (conv_id + turn) % 11 <> 0 GROUP BY ALL) SELECT CASE WHEN v.label = 'odd label' THEN 'untrusted_ambient' ELSE v.label END AS provenance, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM t JOIN v USING (conv_id, turn) GROUP BY 1",
    }
    return out
