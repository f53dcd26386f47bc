"""Queries of the page-text operators over the driver's tables, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import exprs, tables
from inkwell.functions.exprs import SPACE
from inkwell.operators import alignment, geometry, images, layout, terms
from inkwell.sources import archives

# Inline texts in the scripts that the tables do not have: (page, bubble, text).
SCRIPTS = (
    (-3, 0, "田中さんと鈴木-君は先輩です"), (-3, 1, "김철수 씨 안녕 민수선배"), (-3, 2, "王先生 和 李小姐 是 师父"),
    (-2, 0, "éTanaka met Tanaka and ABc, x²Abc Hanako-san"), (-2, 1, "　"), (-2, 2, ""), (-1, 0, "山田先生　山田先生"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("bubble"), "text")
    return own.union(spark.createDataFrame(SCRIPTS, "page long, bubble long, text string"))


def _stub(text):
    """The stub translation of a text."""
    return F.concat(F.lit("<"), text, F.lit(">"))


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("bubble"), "text")


def _sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


BUBBLES = f"bubbles AS (SELECT conv_id AS page, turn AS bubble, text FROM conversations UNION ALL SELECT * FROM (VALUES {_sql_rows(SCRIPTS)}) v(page, bubble, text))"
TALK = "talk AS (SELECT conv_id AS page, turn AS bubble, text FROM conversations)"
_W = exprs.WORD


def _named(endings: list[str]) -> str:
    return rf"regexp_extract_all(text, '({_W}+)[-{SPACE}]?({'|'.join(endings)})', 1)"


_STOP = ", ".join(f"'{w}'" for w in terms.STOP_WORDS)
HITS = rf"""
phases AS (
  SELECT page, bubble, 0 AS phase, {_named(tables.HONORIFICS_JA)} AS words FROM bubbles
  UNION ALL SELECT page, bubble, 1, {_named(tables.HONORIFICS_KO)} FROM bubbles
  UNION ALL SELECT page, bubble, 2, {_named(tables.TITLES_ZH)} FROM bubbles
  UNION ALL SELECT page, bubble, 3, list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,}}')) FROM bubbles
  UNION ALL SELECT page, bubble, 4, list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda w: w <> '' AND w NOT IN ({_STOP})) FROM bubbles
), hits AS (
  SELECT page, bubble, phase, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS pos FROM phases
), seen AS (SELECT * FROM hits WHERE length(term) >= 2
), counted AS (
  SELECT term, count(*) AS n, min(page * 1000000000000 + bubble * 1000000000 + phase * 100000000 + pos) AS place FROM seen GROUP BY term
)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {BUBBLES}, {HITS} SELECT term, n, row_number() OVER (ORDER BY n DESC, place) AS rank FROM counted ORDER BY n DESC, place LIMIT 20")
def key_terms(spark, sf_dir):
    return terms.top(terms.counts(terms.hits(_bubbles(spark, sf_dir)))).select("term", "n", "rank")


@query(f"WITH {BUBBLES}, {HITS} SELECT term, n FROM counted")
def term_counts(spark, sf_dir):
    return terms.counts(terms.hits(_bubbles(spark, sf_dir))).select("term", "n")


@query(f"WITH {BUBBLES}, {HITS} SELECT phase, count(*) AS n, count(DISTINCT term) AS terms FROM seen GROUP BY phase")
def hits_by_pattern(spark, sf_dir):
    return terms.hits(_bubbles(spark, sf_dir)).groupBy("phase").agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms"))


@query(f"""WITH {BUBBLES}, {HITS}, manual AS (SELECT DISTINCT c_mktsegment AS term FROM customer)
SELECT term, sum(w)::BIGINT AS n FROM (SELECT term, 1 AS w FROM seen UNION ALL SELECT term, 5 FROM manual) GROUP BY term""")
def weighted_terms(spark, sf_dir):
    manual = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("term"), F.lit(0).alias("at")).distinct()
    return terms.counts(terms.hits(_bubbles(spark, sf_dir)), manual).select("term", F.col("n").cast("long").alias("n"))


_SUMMARY = f"""last3 AS (SELECT DISTINCT page FROM talk ORDER BY page DESC LIMIT 3), first3 AS (
  SELECT page, bubble, text FROM talk WHERE page IN (SELECT page FROM last3) AND length(text) > 10 ORDER BY page, bubble LIMIT 3
), story AS (SELECT CASE WHEN count(*) > 0 THEN string_agg(text, ' | ' ORDER BY page, bubble) || '...' ELSE '' END AS summary FROM first3)"""


@query(f"WITH {TALK}, {_SUMMARY} SELECT * FROM story")
def story_summary(spark, sf_dir):
    return terms.summary(_talk(spark, sf_dir))


@query("SELECT DISTINCT conv_id AS page FROM conversations ORDER BY page DESC LIMIT 5")
def recent_pages(spark, sf_dir):
    return terms.recent(_talk(spark, sf_dir).select("page").distinct())


@query(f"""WITH {BUBBLES}, {HITS}, {TALK}, {_SUMMARY}, ranked AS (SELECT term, n, place FROM counted ORDER BY n DESC, place LIMIT 20),
shown AS (SELECT term, n, place FROM ranked WHERE n >= 2 ORDER BY n DESC, place LIMIT 15),
lines AS (SELECT string_agg('  ' || term || CASE WHEN length(term) = 3 THEN ' → ' || '<' || term || '>' ELSE ' (×' || n || ')' END || chr(10), '' ORDER BY n DESC, place) AS body FROM shown)
SELECT '---' || chr(10) || 'CONTEXT MEMORY:' || chr(10) || 'CHARACTER NAMES (use consistently):' || chr(10) || '  Tanaka → TANAKA' || chr(10) || '  Hanako → HANAKO' || chr(10)
  || coalesce('KEY TERMS (translate consistently):' || chr(10) || body, '') || CASE WHEN summary <> '' THEN 'STORY SO FAR:' || chr(10) || '  ' || summary || chr(10) ELSE '' END || '---' || chr(10) AS prompt
FROM lines, story""")
def context_prompt(spark, sf_dir):
    ranked = terms.top(terms.counts(terms.hits(_bubbles(spark, sf_dir))))
    known = ranked.where(F.length("term") == 3).select("term", _stub("term").alias("translated"))
    names = spark.createDataFrame([("Tanaka", "TANAKA", 0), ("Hanako", "HANAKO", 1)], "term string, translated string, seq int")
    return terms.context_prompt(ranked, terms.summary(_talk(spark, sf_dir)), known, names)


@query(f"""WITH {BUBBLES}, {HITS}, pages AS (SELECT DISTINCT page FROM bubbles), {TALK}, {_SUMMARY}
SELECT 0 AS terms, 2 AS names, (SELECT count(*) FROM counted) AS tracked_words, (SELECT least(count(*), 5) FROM pages) AS recent_pages, (SELECT summary <> '' FROM story) AS has_summary""")
def session_stats(spark, sf_dir):
    b = _bubbles(spark, sf_dir)
    return terms.session_stats(terms.hits(b), b, terms.summary(_talk(spark, sf_dir)), names=2)


_BATCHES = rf"""speaking AS (SELECT DISTINCT page FROM talk WHERE regexp_replace(text, '[{SPACE}]', '', 'g') <> ''),
numbered AS (SELECT page, row_number() OVER (ORDER BY page) - 1 AS number, ((row_number() OVER (ORDER BY page) - 1) // 10)::BIGINT AS batch FROM speaking)"""


def _batches(spark, sf_dir):
    return terms.batches(_talk(spark, sf_dir).where(~exprs.is_blank(F.col("text"))).select("page").distinct())


@query(f"WITH {TALK}, {_BATCHES} SELECT * FROM numbered")
def page_batches(spark, sf_dir):
    return _batches(spark, sf_dir).select("page", F.col("number").cast("long").alias("number"), "batch")


@query("WITH n AS (SELECT doc_id AS page, text, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents) SELECT *, (number // 10)::BIGINT AS batch FROM n")
def document_batches(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")
    return terms.batches(docs).select("page", "text", F.col("number").cast("long").alias("number"), "batch")


_CARRIED = f"""{TALK}, bubbles AS (SELECT * FROM talk), {HITS}, {_BATCHES}, each AS (SELECT batch, term, count(*) AS m FROM seen JOIN numbered USING (page) GROUP BY ALL),
carried AS (SELECT term, sum(m) OVER w ::BIGINT AS n, batch + 1 AS from_batch, lead(batch) OVER w AS until_batch FROM each WINDOW w AS (PARTITION BY term ORDER BY batch))"""


def _carried(spark, sf_dir):
    numbered = _batches(spark, sf_dir).select("page", "batch")
    seen = terms.hits(_talk(spark, sf_dir).join(numbered, "page"), "batch")
    return terms.carried(seen), numbered


@query(f"WITH {_CARRIED} SELECT * REPLACE (coalesce(until_batch, -1) AS until_batch) FROM carried")
def carried_terms(spark, sf_dir):
    return _carried(spark, sf_dir)[0].withColumn("until_batch", F.coalesce("until_batch", F.lit(-1)))  # -1: all that follow


@query(f"""WITH {_CARRIED}, b AS (SELECT DISTINCT batch FROM numbered ORDER BY batch DESC LIMIT 3)
SELECT b.batch, e.term, sum(m)::BIGINT AS n FROM b JOIN each e ON e.batch < b.batch GROUP BY ALL""")
def state_of_last_batches(spark, sf_dir):
    stretches, numbered = _carried(spark, sf_dir)
    return terms.state_before(stretches, numbered.select("batch").distinct().orderBy(F.col("batch").desc()).limit(3))


@query(f"""WITH {_CARRIED}, b AS (SELECT DISTINCT batch FROM numbered ORDER BY batch DESC LIMIT 3),
s AS (SELECT b.batch, e.term, sum(m)::BIGINT AS n FROM b JOIN each e ON e.batch < b.batch GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, term) AS k FROM s),
x AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY k) AS j FROM r WHERE k <= 20 AND n >= 2),
lines AS (SELECT batch, string_agg('  ' || term || ' (×' || n || ')' || chr(10), '' ORDER BY j) AS body FROM x WHERE j <= 15 GROUP BY 1)
SELECT batch, coalesce('---' || chr(10) || 'CONTEXT MEMORY:' || chr(10) || 'KEY TERMS (translate consistently):' || chr(10) || body || '---' || chr(10), '') AS prompt FROM b LEFT JOIN lines USING (batch)""")
def batch_contexts(spark, sf_dir):
    stretches, numbered = _carried(spark, sf_dir)
    return terms.batch_contexts(stretches, numbered.select("batch").distinct().orderBy(F.col("batch").desc()).limit(3))


@query(f"""WITH {TALK}, {_BATCHES}, pages_ AS (SELECT page, list(text ORDER BY bubble) AS original FROM talk GROUP BY 1), p AS (SELECT * FROM pages_ JOIN numbered USING (page)), ends AS (SELECT batch, max(number) AS e FROM numbered GROUP BY 1)
SELECT ends.batch, (row_number() OVER (PARTITION BY ends.batch ORDER BY p.number) - 1)::INT AS slot, p.page, p.original, p.original AS translated FROM ends JOIN p ON p.number BETWEEN ends.e - 4 AND ends.e""")
def recent_of_batches(spark, sf_dir):
    pages = alignment.page_texts(_talk(spark, sf_dir)).join(_batches(spark, sf_dir), "page")
    views = terms.recent_before(pages.select("batch", F.col("number").cast("long").alias("number"), "page", F.col("texts").alias("original"), F.col("texts").alias("translated")))
    return views.select("batch", F.posexplode("recent").alias("slot", "r")).select("batch", "slot", "r.page", "r.original", "r.translated")


_RAW = r"""answers AS (SELECT conv_id AS id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1),
lines AS (SELECT id, unnest(['  a → ' || id, 'no arrow', 'a →  ' || (id + 1) || ' → c', ' → empty', 'b →', 'left' || (id % 3) || '→right']) AS line, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS pos FROM answers)"""


@query(rf"""WITH {_RAW}, cut AS (SELECT id, pos, regexp_replace(line[:instr(line, '→') - 1], '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS term, regexp_replace(line[instr(line, '→') + 1:], '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS translated FROM lines WHERE contains(line, '→'))
SELECT id, term, arg_max(translated, pos) AS translated FROM cut WHERE term <> '' AND translated <> '' GROUP BY ALL""")
def extracted_terms(spark, sf_dir):
    lines = F.concat_ws("\n", F.concat(F.lit("  a → "), F.col("page").cast("string")), F.lit("no arrow"), F.concat(F.lit("a →  "), (F.col("page") + 1).cast("string"), F.lit(" → c")), F.lit(" → empty"), F.lit("b →"), F.concat(F.lit("left"), (F.col("page") % 3).cast("string"), F.lit("→right")))
    raw = alignment.page_texts(_talk(spark, sf_dir)).select("page", F.array_join("texts", "\n").alias("body"))
    return terms.extracted(raw.select(F.col("page").alias("id"), F.concat("body", F.lit("\n[TERMS]\n"), lines, F.lit("\n[/TERMS]\n[TERMS]x → y[/TERMS]")).alias("raw")))


# alignment: the stub translator puts texts in brackets; pages with page % 5 = 0 get an answer that is no JSON, so none; page % 5 = 1 one text too few, page % 5 = 2 one too many


def _answers(spark, sf_dir):
    pages = alignment.page_texts(_talk(spark, sf_dir)).withColumn("texts", F.transform("texts", _stub))
    cut = F.when(F.col("page") % 5 == 1, F.slice("texts", F.lit(1), F.greatest(F.size("texts") - 1, F.lit(0)))).when(F.col("page") % 5 == 2, F.concat("texts", F.array(F.lit("EXTRA")))).otherwise(F.col("texts"))
    return pages.where(F.col("page") % 5 != 0).select("page", cut.alias("texts"))


_ANSWERS = f"""{TALK}, numbered AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY bubble) - 1 AS slot, count(*) OVER (PARTITION BY page) AS size FROM talk),
given AS (SELECT page, slot, '<' || text || '>' AS answer, size FROM numbered WHERE page % 5 <> 0 AND NOT (page % 5 = 1 AND slot = size - 1)),
given_pages AS (SELECT DISTINCT page, size FROM numbered WHERE page % 5 <> 0), extra AS (SELECT page, size AS slot, 'EXTRA' AS answer, size FROM given_pages WHERE page % 5 = 2),
answers AS (SELECT * FROM given UNION ALL SELECT * FROM extra)"""


@query(f"WITH {TALK} SELECT page, bubble, text, '<' || text || '>' AS translated FROM talk")
def paired_bubbles(spark, sf_dir):
    answers = alignment.page_texts(_talk(spark, sf_dir)).withColumn("texts", F.concat(F.transform("texts", _stub), F.array(F.lit("EXTRA"))))
    return alignment.paired(_talk(spark, sf_dir), answers).select("page", "bubble", "text", "translated")


_STATUS = "CASE WHEN p.page IS NULL THEN 'fallback' WHEN a.answer IS NULL THEN 'missing' ELSE 'answer' END AS status"


@query(f"WITH {_ANSWERS} SELECT t.page, t.bubble, t.text, CASE WHEN p.page IS NULL THEN t.text ELSE a.answer END AS translated, {_STATUS} FROM talk t LEFT JOIN given_pages p USING (page) LEFT JOIN answers a ON a.page = t.page AND a.slot = t.bubble")
def fallback_pages(spark, sf_dir):
    return alignment.with_fallback(_talk(spark, sf_dir), _answers(spark, sf_dir))


@query(f"WITH {_ANSWERS} SELECT t.page, t.bubble, t.text, coalesce(a.answer, t.text) AS translated, CASE WHEN a.answer IS NULL THEN 'padded' ELSE 'answer' END AS status FROM talk t LEFT JOIN answers a ON a.page = t.page AND a.slot = t.bubble")
def reconciled_lengths(spark, sf_dir):
    return alignment.reconciled(_talk(spark, sf_dir), _answers(spark, sf_dir))


@query(f"""WITH {_ANSWERS}, good AS (SELECT page FROM given_pages WHERE page % 5 NOT IN (1, 2))
SELECT t.page, t.bubble, t.text, CASE WHEN p.page IS NULL THEN t.text ELSE a.answer END AS translated, {_STATUS} FROM talk t LEFT JOIN good p USING (page) LEFT JOIN answers a ON a.page = t.page AND a.slot = t.bubble""")
def refused_lengths(spark, sf_dir):
    return alignment.strict(_talk(spark, sf_dir), _answers(spark, sf_dir))


_BOTH = f"""{TALK}, numbered AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY bubble) - 1 AS slot, count(*) OVER (PARTITION BY page) AS size FROM talk)"""


def _both(spark, sf_dir):
    """Texts of all pages and their translations; every seventh bubble's is empty."""
    own = alignment.page_texts(_talk(spark, sf_dir))
    return own, own.withColumn("texts", F.transform("texts", lambda t, i: F.when(i % 7 == 6, "").otherwise(_stub(t))))


@query(f"WITH {_BOTH} SELECT page, slot::INT AS bubble, text, '<' || text || '>' AS translated FROM numbered WHERE text <> '' AND slot % 7 <> 6")
def term_pairs(spark, sf_dir):
    return alignment.pairs_for_terms(*_both(spark, sf_dir))


@query(f"WITH {_BOTH}, bubbles AS (SELECT page, slot AS bubble, text FROM numbered WHERE slot % 7 <> 6), {HITS} SELECT term, n FROM counted")
def counted_terms(spark, sf_dir):
    return terms.counts(terms.counted_hits(*_both(spark, sf_dir))).select("term", "n")


@query("SELECT p_partkey AS page, coalesce(t.texts, []) AS texts FROM part LEFT JOIN (SELECT conv_id AS page, list(text ORDER BY turn) AS texts FROM conversations GROUP BY 1) t ON t.page = p_partkey")
def texts_of_pages(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"))
    return alignment.texts_of(names, alignment.page_texts(_talk(spark, sf_dir)))


@query("SELECT o_orderkey AS batch, CASE WHEN o_orderkey % 3 < 2 THEN 'p' || o_orderkey END AS page, CASE WHEN o_orderkey % 3 < 2 THEN ['a' || o_orderkey, 'b'] END AS texts FROM orders")
def parsed_page_answers(spark, sf_dir):
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"p'), k.cast("string"), F.lit('": ["a'), k.cast("string"), F.lit('", "b"]}'))
    raw = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 3 == 1, body).otherwise("no object")
    return alignment.answered_pages(_table(spark, sf_dir, "orders").select(k.alias("batch"), raw.alias("raw")))


_LINES = r"lines AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS bubble FROM documents)"


def _lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("bubble", "text"))


@query(rf"""WITH {_LINES}, blanked AS (SELECT page, bubble, CASE WHEN bubble % 3 = 1 THEN ' ' || chr(9) || chr(12288) ELSE text END AS text FROM lines),
speaking AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY bubble) - 1 AS pos FROM blanked WHERE regexp_replace(text, '[{SPACE}]', '', 'g') <> '')
SELECT b.page, b.bubble, b.text, CASE WHEN s.pos % 2 = 0 THEN 'line ' || s.pos ELSE b.text END AS translated, CASE WHEN s.pos % 2 = 0 THEN 'answer' ELSE 'kept' END AS status
FROM blanked b LEFT JOIN speaking s USING (page, bubble)""")
def overlaid_lines(spark, sf_dir):
    blanked = _lines(spark, sf_dir).withColumn("text", F.when(F.col("bubble") % 3 == 1, F.lit(" \t　")).otherwise(F.col("text")))
    answers = alignment.speaking(blanked).where("pos % 2 = 0").select("page", "pos", F.concat(F.lit("line "), F.col("pos").cast("string")).alias("answer"))
    return alignment.overlay(blanked, answers)


@query("SELECT conv_id AS page, list(text ORDER BY turn) AS texts FROM conversations GROUP BY 1")
def collected_pages(spark, sf_dir):
    return alignment.page_texts(_talk(spark, sf_dir))


@query("SELECT source, arg_max(text, doc_id) AS text, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def last_of_each_source(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", "text", "doc_id")
    return alignment.last_write(docs, ["source"], "doc_id")


@query("SELECT count(*) FILTER (turn % 7 <> 0 AND turn % 3 <> 0) AS success, count(*) FILTER (turn % 7 <> 0 AND turn % 3 = 0) AS empty, count(*) FILTER (turn % 7 = 0) AS errors FROM conversations")
def recognition_outcome(spark, sf_dir):
    t = F.col("bubble")
    return alignment.outcome(_talk(spark, sf_dir).select(F.when(t % 3 != 0, F.col("text")).alias("text"), F.when(t % 7 == 0, "HTTP 503").alias("error")))


@query(r"""WITH raw AS (SELECT conv_id AS page, count(*) AS n, list('<' || text || '>' ORDER BY turn) AS texts FROM conversations GROUP BY 1)
SELECT page, CASE WHEN page % 4 IN (0, 1) THEN texts END AS texts, CASE page % 4 WHEN 2 THEN 'wrong_length' WHEN 3 THEN 'not_json' ELSE 'answer' END AS status FROM raw""")
def parsed_answers(spark, sf_dir):
    pages = alignment.page_texts(_talk(spark, sf_dir)).withColumn("n", F.size("texts"))
    body = F.to_json(F.transform("texts", _stub))
    long = F.to_json(F.concat("texts", F.array(F.lit("more"))))
    k = F.col("page") % 4
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("  ```"), body, F.lit("``` \n"))).when(k == 2, long).otherwise(F.lit("I cannot do that"))
    return alignment.answered(pages.select("page", "n", raw.alias("raw")))


@query("SELECT event_id, event_type, (json_extract_string(props, '$.k'))::INT AS k, '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS line FROM events")
def json_round_trip(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", exprs.json_value(F.col("props"), "k int")["k"].alias("k"), exprs.json_line(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("line"))


# geometry: boxes from lineitem, page sizes from orders, row profiles from events

_BOXES = """boxes AS (
  SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord,
         l_partkey * 7 % 160 AS x1, l_suppkey * 13 % 160 AS y1, l_partkey * 7 % 160 + 40 + l_partkey % 90 AS x2, l_suppkey * 13 % 160 + 40 + (l_suppkey + l_linenumber) % 90 AS y2, l_discount AS conf FROM lineitem)"""


def _boxes(spark, sf_dir):
    from pyspark.sql import Window

    li = _table(spark, sf_dir, "lineitem")
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    x, y = p * 7 % 160, s * 13 % 160
    return li.select(F.col("l_orderkey").alias("page"), ord_.cast("long").alias("ord"), x.alias("x1"), y.alias("y1"), (x + 40 + p % 90).alias("x2"), (y + 40 + (s + F.col("l_linenumber")) % 90).alias("y2"), F.col("l_discount").alias("conf"))


_PAIR = """greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1))"""


@query(f"""WITH {_BOXES}, pairs AS (SELECT p.page, p.ord AS a, q.ord AS b, {_PAIR} AS i, (p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) AS s FROM boxes p JOIN boxes q ON p.page = q.page AND p.ord < q.ord)
SELECT page, a, b, i / (s - i) AS iou FROM pairs WHERE 2 * i >= s - i""")
def overlapping_boxes(spark, sf_dir):
    return geometry.overlapping(_boxes(spark, sf_dir))


@query(f"""WITH RECURSIVE {_BOXES}, s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY conf DESC, ord) AS n FROM boxes),
r(page, n, kept) AS (
  SELECT DISTINCT page, 0::BIGINT, []::BIGINT[] FROM s UNION ALL
  SELECT q.page, q.n, CASE WHEN EXISTS (SELECT 1 FROM s p WHERE p.page = q.page AND list_contains(r.kept, p.n)
    AND 3 * {_PAIR} >= (p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1)) THEN r.kept ELSE list_append(r.kept, q.n) END
  FROM r JOIN s q ON q.page = r.page AND q.n = r.n + 1
), last AS (SELECT page, arg_max(kept, n) AS kept FROM r GROUP BY page), out AS (SELECT page, unnest(kept) AS n, generate_subscripts(kept, 1) - 1 AS rank FROM last)
SELECT s.page, out.rank::INT AS rank, s.ord, s.x1, s.y1, s.x2, s.y2, s.conf FROM out JOIN s ON s.page = out.page AND s.n = out.n""")
def suppressed_boxes(spark, sf_dir):
    return geometry.suppressed(_boxes(spark, sf_dir))


_CANDIDATES = """cand AS (SELECT page, ord, x1 AS x, y1 AS y, (x2 - x1) * CASE WHEN ord % 4 = 3 THEN 9 ELSE 1 END AS w, CASE WHEN ord % 5 = 4 THEN 0 ELSE y2 - y1 END AS h, mean, (x2 - x1) * (y2 - y1) * (40 + page % 60) // 100 AS area FROM (SELECT *, (page * 17 + ord * 31) % 120 AS mean FROM boxes))"""


@query(f"""WITH {_BOXES}, {_CANDIDATES} SELECT page, ord, x AS x1, y AS y1, x + w AS x2, y + h AS y2, round(least(0.8, CASE WHEN w * h > 0 THEN area / (w * h) ELSE 0 END * (1 - mean / 255)), 6) AS conf FROM cand
WHERE area BETWEEN 1000 AND 11200 AND CASE WHEN h > 0 THEN w / h ELSE 0 END BETWEEN 0.2 AND 5.0 AND CASE WHEN w * h > 0 THEN area / (w * h) ELSE 0 END >= 0.3 AND mean <= 80""")
def dark_regions(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("mean", (F.col("page") * 17 + F.col("ord") * 31) % 120)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cand = b.select("page", "ord", F.col("x1").alias("x"), F.col("y1").alias("y"), (w * F.when(F.col("ord") % 4 == 3, 9).otherwise(1)).alias("w"), F.when(F.col("ord") % 5 == 4, 0).otherwise(h).alias("h"), "mean", F.floor(w * h * (40 + F.col("page") % 60) / 100).alias("area"), F.lit(280).alias("page_w"), F.lit(100).alias("page_h"))
    return geometry.dark_boxes(cand).withColumn("conf", F.round("conf", 6))


@query(f"""WITH {_BOXES}, u AS (SELECT *, (ord % 2)::INT AS is_dark FROM boxes)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY is_dark, ord) - 1 AS ord, x1, y1 + 100 AS y1, x2, y2 + 100 AS y2, conf, is_dark FROM u""")
def merged_detections(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    both = geometry.merged(b.where("ord % 2 = 0"), b.where("ord % 2 = 1"))  # each box is of one of two detectors
    return geometry.shifted(both.withColumn("y_start", F.lit(100))).withColumn("ord", F.col("ord").cast("long"))


_PROFILE = """profile AS (SELECT page, y, CASE WHEN y % 97 < 9 + y // 97 % 5 THEN 250.0 WHEN y % 211 BETWEEN 100 AND 112 THEN 10.0 WHEN y % 50 = 7 THEN 245.0 ELSE 128.0 + y % 50 END AS mean
  FROM (SELECT event_type AS page, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS y FROM events))"""


def _profile(spark, sf_dir):
    from pyspark.sql import Window

    y = F.col("y")
    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("page"), (F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1).alias("y"))
    mean = F.when(y % 97 < 9 + F.floor(y / 97) % 5, 250.0).when((y % 211).between(100, 112), 10.0).when(y % 50 == 7, 245.0).otherwise(128.0 + y % 50)
    return rows.withColumn("mean", mean)


_GUTTERS = """gutters AS (SELECT page, min(y) AS "start", max(y) + 1 AS "end", (min(y) + max(y) + 1) // 2 AS center FROM (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS g FROM profile WHERE mean > 245 OR mean < 15) GROUP BY page, g HAVING count(*) >= 10)"""


@query(f"WITH {_PROFILE}, {_GUTTERS} SELECT * FROM gutters")
def page_gutters(spark, sf_dir):
    return geometry.gutters(_profile(spark, sf_dir))


_CUTS = f"""{_PROFILE}, {_GUTTERS}, g AS (SELECT page, center, row_number() OVER (PARTITION BY page ORDER BY center) AS n FROM gutters),
r(page, n, last, cut) AS (SELECT DISTINCT page, 0::BIGINT, 0::BIGINT, false FROM g UNION ALL
  SELECT g.page, g.n, CASE WHEN g.center - r.last >= 1050 THEN g.center ELSE r.last END, g.center - r.last >= 1050 FROM r JOIN g ON g.page = r.page AND g.n = r.n + 1),
cuts AS (SELECT page, last AS y FROM r WHERE cut)"""


@query(f"WITH RECURSIVE {_CUTS} SELECT p.page, coalesce(list(y ORDER BY y) FILTER (y IS NOT NULL), []) AS cuts FROM (SELECT DISTINCT page FROM gutters) p LEFT JOIN cuts USING (page) GROUP BY 1")
def safe_cuts(spark, sf_dir):
    return geometry.cuts(geometry.gutters(_profile(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_CUTS}, heights AS (SELECT page, count(*) AS height FROM profile GROUP BY 1), edges AS (SELECT page, 0 AS y FROM heights UNION ALL SELECT page, y FROM cuts UNION ALL SELECT page, height FROM heights),
steps AS (SELECT page, (row_number() OVER w - 1)::INT AS chunk, y AS y1, lead(y) OVER w AS y2 FROM edges WINDOW w AS (PARTITION BY page ORDER BY y))
SELECT * FROM steps WHERE y2 - y1 >= 50""")
def page_chunks(spark, sf_dir):
    rows = _profile(spark, sf_dir)
    return geometry.chunks(geometry.cuts(geometry.gutters(rows)), rows.groupBy("page").agg(F.count("*").alias("height")))


_PAGES = "pages_ AS (SELECT o_orderkey AS page, (200 + o_custkey * 7 % 900)::INT AS width, (10 + o_orderkey * 37 % 9000)::INT AS height FROM orders)"


def _pages(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("page"), (200 + F.col("o_custkey") * 7 % 900).cast("int").alias("width"), (10 + F.col("o_orderkey") * 37 % 9000).cast("int").alias("height"))


@query(f"WITH {_PAGES}, t AS (SELECT page, height, unnest(range(0, height + 1, 1300)) AS y1 FROM pages_) SELECT page, y1::INT AS y1, least(y1 + 1500, height)::INT AS y2 FROM t WHERE (y1 = 0 OR y1 + 200 < height) AND least(y1 + 1500, height) - y1 >= 50")
def sliding_tiles(spark, sf_dir):
    return geometry.sliding_tiles(_pages(spark, sf_dir))


@query(f"""WITH {_PAGES}, s AS (SELECT page, height, width * 2 AS m, CASE WHEN height > width * 2 THEN range(0, height, width * 2) ELSE [0::BIGINT] END AS starts FROM pages_),
t AS (SELECT page, height, m, len(starts) AS parts, unnest(starts) AS y1, (generate_subscripts(starts, 1) - 1)::INT AS part FROM s)
SELECT page, part, y1::INT AS y1, CASE WHEN parts > 1 THEN least(y1 + m, height) ELSE height END::INT AS y2, page || CASE WHEN parts > 1 THEN '_part' || (part + 1) ELSE '' END AS name FROM t""")
def tumbling_tiles(spark, sf_dir):
    return geometry.tumbling_tiles(_pages(spark, sf_dir))


@query(f"WITH {_PAGES} SELECT page, round(height / width, 6) AS aspect, height / width > 3.0 AS is_long, height > width * 2 AS is_split, page % 256 < 100 AS is_dark, CASE WHEN page % 256 < 100 THEN 'white' ELSE 'black' END AS ink FROM pages_")
def page_flags(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    dark = geometry.is_dark(F.col("page") % 256)
    return _pages(spark, sf_dir).select("page", F.round(exprs.ratio(h, w), 6).alias("aspect"), geometry.is_long(w, h).alias("is_long"), (h > (w * geometry.SPLIT_RATIO).cast("int")).alias("is_split"), dark.alias("is_dark"), geometry.ink(dark).alias("ink"))


# pictures of 44 x 34 pixels with a dark box each, from part; those of odd keys are inverted where a query says so

_PICTURES = """pictures AS (SELECT p_partkey AS page, (4 + p_partkey % 9)::INT AS x, (3 + p_partkey % 7)::INT AS y, (10 + p_partkey % 18)::INT AS w, (8 + p_partkey % 15)::INT AS h, p_partkey % 40 AS ink FROM part)"""


def _pictures(spark, sf_dir, inverted: bool = False, dealt: bool = False):
    """Image rows whose bytes are made of JVM expressions: three bytes a pixel, all alike.

    Dealt, the rows go to partitions by page before they get their bytes, so a join by page moves no picture.
    """
    k = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select(k.alias("page"), (4 + k % 9).cast("int").alias("x"), (3 + k % 7).cast("int").alias("y"), (10 + k % 18).cast("int").alias("w"), (8 + k % 15).cast("int").alias("h"), (k % 40).alias("ink"))
    if dealt:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page")
    light = F.when(F.lit(inverted) & (F.col("page") % 2 == 1), F.lit("14")).otherwise(F.lit("FF"))
    ink = F.when(F.lit(inverted) & (F.col("page") % 2 == 1), F.lit("FF")).otherwise(F.lpad(F.hex("ink"), 2, "0"))
    blank = F.repeat(light, F.lit(44 * 3))
    line = F.concat(F.repeat(light, F.col("x") * 3), F.repeat(ink, F.col("w") * 3), F.repeat(light, (44 - F.col("x") - F.col("w")) * 3))
    body = F.concat(F.repeat(blank, F.col("y")), F.repeat(line, F.col("h")), F.repeat(blank, 34 - F.col("y") - F.col("h")))
    return rows.select("page", F.lit(34).alias("height"), F.lit(44).alias("width"), F.unhex(body).alias("data"))


@query(f"WITH {_PICTURES}, r AS (SELECT *, unnest(range(34))::INT AS row_ FROM pictures) SELECT page, row_ AS y, round(CASE WHEN row_ >= y AND row_ < y + h THEN (w * ink + (44 - w) * 255) / 44 ELSE 255 END, 6)::DOUBLE AS mean FROM r")
def row_means(spark, sf_dir):
    return images.row_profiles(_pictures(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_PICTURES} SELECT page, 0 AS ord, x, y, w, h, ink::DOUBLE AS mean, 44 AS page_w, 34 AS page_h FROM pictures")
def dark_candidates(spark, sf_dir):
    return images.dark_candidates(_pictures(spark, sf_dir)).drop("area")


@query(f"""WITH {_PICTURES}, p AS (SELECT *, page % 2 = 1 AND (w * h * 255 + (44 * 34 - w * h) * 20) / (44 * 34) < 100 AS dark FROM pictures)
SELECT page, 0 AS bubble, dark AS is_dark, CASE WHEN page % 2 = 1 AND NOT dark THEN (44 * 34 - w * h) * 6 ELSE 0 END AS other_digits FROM p""")
def largest_region(spark, sf_dir):
    crops = _pictures(spark, sf_dir, inverted=True).select("page", F.lit(0).cast("long").alias("bubble"), "height", "width", "data", F.lit(False).alias("force_dark"))
    ground = F.when(F.col("is_dark"), "00").otherwise("FF")
    return images.erased(crops).select("page", F.col("bubble").cast("int").alias("bubble"), "is_dark", F.length(F.replace(F.hex("data"), ground, F.lit(""))).alias("other_digits"))


@query(f"WITH {_PICTURES} SELECT page, 0 AS bubble, h AS height, w AS width, w * h * 3 AS bytes, repeat(lpad(hex(ink), 2, '0'), (w * h * 3)::BIGINT) AS digits FROM pictures")
def cut_out_boxes(spark, sf_dir):
    pictures = _pictures(spark, sf_dir, dealt=True)
    boxes = images.dark_candidates(pictures).select("page", "ord", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.lit(1).alias("is_dark"))
    crops = images.cut_out(pictures, boxes)
    return crops.select("page", F.col("bubble").cast("int").alias("bubble"), "height", "width", F.octet_length("data").alias("bytes"), F.hex("data").alias("digits"))


# layout


def _wrap_sql(text: str, width: str) -> str:
    return f"list_reduce(string_split(replace({text}, chr(10), ' '), ' '), lambda a, w: CASE WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(w) <= {width} THEN a || ' ' || w ELSE a || chr(10) || w END)"


@query(f"SELECT conv_id AS page, turn AS bubble, {_wrap_sql('text', '24')} AS lines FROM conversations")
def wrapped_text(spark, sf_dir):
    return _talk(spark, sf_dir).select("page", "bubble", layout.wrapped(F.col("text"), F.lit(24)).alias("lines"))


_LAYOUT_IN = "SELECT conv_id * 100 + turn AS id, text, (conv_id * 13 + turn * 37) % 400 AS w, (conv_id * 29 + turn * 53) % 300 AS h FROM conversations"


def _laid(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    a, t = F.col("conv_id"), F.col("turn")
    return layout.fitted(c.select((a * 100 + t).alias("id"), "text", ((a * 13 + t * 37) % 400).alias("w"), ((a * 29 + t * 53) % 300).alias("h")))


_FIT = f"""b AS ({_LAYOUT_IN}), u AS (SELECT *, trunc(w * 0.8::DOUBLE)::BIGINT AS uw, trunc(h * 0.8::DOUBLE)::BIGINT AS uh FROM b),
f AS (SELECT *, greatest(10, least(60, trunc(sqrt(uw * uh / (greatest(length(text), 1) * 0.8::DOUBLE)))))::BIGINT AS first FROM u),
z AS (SELECT id, text, w, h, uw, uh, unnest(range(first, 9, -2)) AS size FROM f WHERE uw > 0 AND uh > 0),
c AS (SELECT *, greatest(1, trunc(uw / (size * 0.6::DOUBLE)))::BIGINT AS width FROM z),
l AS (SELECT id, uw, uh, size, {_wrap_sql('text', 'width')} AS lines FROM c),
g AS (SELECT id, size, lines FROM l WHERE len(string_split(lines, chr(10))) * trunc(size * 1.3::DOUBLE) <= uh AND len(list_filter(string_split(lines, chr(10)), lambda x: length(x) * (size * 0.6::DOUBLE) > uw)) = 0),
best AS (SELECT id, max(size) AS size, arg_max(lines, size) AS lines FROM g GROUP BY id),
laid AS (SELECT u.id, w, h, coalesce(size, 10)::INT AS font_size, CASE WHEN uw <= 0 OR uh <= 0 THEN 10 ELSE trunc(coalesce(size, 10) * 1.3::DOUBLE) END::INT AS line_height, coalesce(best.lines, text) AS lines FROM u LEFT JOIN best USING (id))"""


@query(f"WITH {_FIT} SELECT * FROM laid")
def fitted_text(spark, sf_dir):
    return _laid(spark, sf_dir)


@query(f"""WITH {_FIT}, s AS (SELECT *, string_split(lines, chr(10)) AS ls FROM laid), e AS (SELECT id, w, h, font_size, line_height, len(ls) AS k, unnest(ls) AS text, (generate_subscripts(ls, 1) - 1)::INT AS line FROM s)
SELECT id, line, text, floor((w - trunc(length(text) * font_size * 0.6::DOUBLE)) / 2)::INT AS x, (floor((h - k * line_height) / 2) + line * line_height)::INT AS y FROM e""")
def placed_lines(spark, sf_dir):
    return layout.placed_lines(_laid(spark, sf_dir))


# expressions over rows


def _map_sql(key: str, table: dict[str, str], default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {key} {cases} ELSE {default} END"


@query(f"""SELECT doc_id, {_map_sql('lang', tables.LANGUAGE_NAMES, "'Japanese'")} AS source_name, {_map_sql('lang', tables.NLLB_CODES, "'jpn_Jpan'")} AS nllb, {_map_sql('lang', tables.BAIDU_CODES, 'lang')} AS baidu FROM documents""")
def language_lookups(spark, sf_dir):
    lang = F.col("lang")
    return _table(spark, sf_dir, "documents").select("doc_id", exprs.lookup(lang, tables.LANGUAGE_NAMES, F.lit("Japanese")).alias("source_name"), exprs.lookup(lang, tables.NLLB_CODES, F.lit("jpn_Jpan")).alias("nllb"), exprs.lookup(lang, tables.BAIDU_CODES, lang).alias("baidu"))


_NAMES = "['AnimeAce', 'Auto (Match Original)', 'Yuki-Burobu', 'Arial', 'MangaT', 'yuki-x'][(p_partkey % 6) + 1]"


@query(f"""WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.tar.gz' ELSE '' END AS file, {_NAMES} AS raw FROM part),
m AS (SELECT *, CASE WHEN lower(raw) = 'auto (match original)' THEN 'auto' WHEN lower(raw) = 'animeace' THEN 'animeace_' WHEN starts_with(raw, 'Yuki-') THEN raw ELSE lower(raw) END AS font FROM n)
SELECT p_partkey, regexp_replace(file, '([^./])\\.[^./]*$', '\\1') AS stem, CASE WHEN length(file) <= 12 THEN file ELSE file[:9] || '...' END AS shown, font,
  'fonts/' || font || CASE WHEN font IN ('animeace_', 'arial', 'mangat') THEN 'i' ELSE '' END || '.ttf' AS path FROM m""")
def file_and_font_names(spark, sf_dir):
    k = F.col("p_partkey")
    file = F.concat("p_name", F.when(k % 3 == 0, ".jpg").when(k % 3 == 1, ".tar.gz").otherwise(""))
    raw = F.element_at(F.array(*[F.lit(x) for x in ("AnimeAce", "Auto (Match Original)", "Yuki-Burobu", "Arial", "MangaT", "yuki-x")]), (k % 6 + 1).cast("int"))
    font = exprs.font_choice(raw)
    return _table(spark, sf_dir, "part").select("p_partkey", exprs.stem(file).alias("stem"), exprs.short_name(file, 12).alias("shown"), font.alias("font"), exprs.font_path(font).alias("path"))


_FONT_LIST = "[" + ", ".join(f"'{f}'" for f in tables.FONTS) + "]"


@query(f"""WITH a AS (SELECT p_partkey, ({_FONT_LIST})[p_partkey % 24 + 1] AS f FROM part), t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN f WHEN 1 THEN lower(f) WHEN 2 THEN lower(f) || ' regular' WHEN 3 THEN f[3:12] ELSE 'wingdings 7' END AS text FROM a)
SELECT p_partkey, CASE WHEN list_contains({_FONT_LIST}, text) THEN text ELSE coalesce(list_filter({_FONT_LIST}, lambda f: contains(lower(f), lower(text)) OR contains(lower(text), lower(f)))[1], 'animeace_') END AS font FROM t""")
def picked_fonts(spark, sf_dir):
    k = F.col("p_partkey")
    f = F.element_at(F.array(*[F.lit(x) for x in tables.FONTS]), (k % 24 + 1).cast("int"))
    answer = F.when(k % 5 == 0, F.concat(F.lit('  "'), f, F.lit('" '))).when(k % 5 == 1, F.concat(F.lit("the best MATCHING font is "), F.lower(f))).when(k % 5 == 2, F.concat(F.lit("Font: I recommend "), F.lower(f), F.lit(" regular"))).when(k % 5 == 3, F.substring(f, 3, 10)).otherwise("wingdings 7")
    return _table(spark, sf_dir, "part").select("p_partkey", exprs.picked_font(answer).alias("font"))


@query(rf"""SELECT conv_id, turn, replace(text, '.', '．') = text AS same, replace(text, ' ', '.') AS pre, replace(text[:50], chr(10), ' ') || CASE WHEN length(text) > 50 THEN '...' ELSE '' END AS preview,
  CASE WHEN turn % 3 = 0 THEN '' ELSE chr(10) || 'Style instructions: ' || role END AS style, trunc(turn / greatest(turn % 5, 1) * 100)::INT AS percent,
  round(0.5 * 2 ** turn, 6)::DOUBLE AS llm_delay, round(2 ** (turn + 1) * 1.25, 6)::DOUBLE AS ocr_delay, turn % 4 < 2 AS retryable, turn % 4 IN (1, 2) AS quota FROM conversations""")
def text_expressions(spark, sf_dir):
    t, text = F.col("turn"), F.col("text")
    error = F.element_at(F.array(F.lit("HTTP 503"), F.lit("code 429"), F.lit("Quota spent"), F.lit("refused")), (t % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.replace(text, F.lit("."), F.lit("．")) == text).alias("same"), exprs.preprocessed(F.replace(text, F.lit(" "), F.lit("．"))).alias("pre"), exprs.preview(text).alias("preview"),
        exprs.style_line(F.when(t % 3 == 0, "").otherwise(F.col("role"))).alias("style"), exprs.percent(t, t % 5).alias("percent"),
        F.round(exprs.llm_delay(t), 6).alias("llm_delay"), F.round(exprs.ocr_delay(t, F.lit(0.25)), 6).alias("ocr_delay"), exprs.is_retryable(error).alias("retryable"), exprs.is_quota(error).alias("quota"),
    )


@query("SELECT page_id, base64(encode(html)) AS data, octet_length(encode(html)) AS bytes FROM pages")
def encoded_pages(spark, sf_dir):
    data = archives.encoded(F.col("html").cast("binary"))
    return _table(spark, sf_dir, "pages").select("page_id", data.alias("data")).withColumn("bytes", F.octet_length(archives.decoded(F.col("data"))).cast("long"))


@query("""WITH n AS (SELECT page_id // 7 AS job, page_id, html, row_number() OVER (PARTITION BY page_id // 7 ORDER BY page_id) - 1 AS i FROM pages)
SELECT job, i::INT AS i, 'out/' || CASE WHEN page_id % 3 = 0 THEN 'image_' || (i + 1) ELSE 'page' || page_id END || '_translated.jpg' AS name, md5(encode(html)) AS digest FROM n""")
def job_archives(spark, sf_dir):
    name = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("page"), F.col("page_id").cast("string")))
    item = F.struct("page_id", F.struct(name.alias("name"), archives.encoded(F.col("html").cast("binary")).alias("data")).alias("image"))
    jobs = _table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 7).alias("job")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    listed = archives.listed(jobs.select("job", exprs.json_line(F.transform("items", lambda x: x["image"])).alias("images")))
    return archives.contents(archives.zipped(listed, folder="out/")).select("job", "i", "name", F.md5("data").alias("digest"))


@query("SELECT turn, '{\"phase\":\"' || role || '\",\"current\":' || turn || ',\"total\":' || (turn % 5) || ',\"message\":\"page ' || conv_id || '\",\"percent\":' || trunc(turn / greatest(turn % 5, 1) * 100)::INT || '}' AS event FROM conversations")
def progress_events(spark, sf_dir):
    message = F.concat(F.lit("page "), F.col("conv_id").cast("string"))
    return _table(spark, sf_dir, "conversations").select("turn", exprs.progress(F.col("role"), F.col("turn"), F.col("turn") % 5, message).alias("event"))


@query(f"WITH {_BOXES} SELECT * FROM boxes ORDER BY page, ord LIMIT 1")
def first_detection(spark, sf_dir):
    return alignment.first_of_first(_boxes(spark, sf_dir))


@query("SELECT count(DISTINCT conv_id) AS images, count(*) AS bubbles, list(first ORDER BY first)[:5] AS first_files, count(DISTINCT conv_id) - len(list(first ORDER BY first)[:5]) AS more FROM (SELECT conv_id, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN conv_id END AS first FROM conversations)".replace("list(first ORDER BY first)", "list_filter(list(first ORDER BY first), lambda x: x IS NOT NULL)"))
def totals_and_preview(spark, sf_dir):
    return alignment.totals(_talk(spark, sf_dir))
