"""The registered queries over the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions import generated, intent, structured, text
from ragloom.functions.embedding import embed
from ragloom.operators import answers, chunking, expansion, fulltext, search
from ragloom.operators import records as record_answers
from ragloom.operators.corpus import delete, metadata_value, upsert
from ragloom.operators.versions import stable
from ragloom.sources.files import clean_slide_text
from ragloom.streaming import files

from .fixtures import CORPUS_SQL, MESSAGES_SQL, QUESTIONS_SQL, RECORDS_SQL, corpus, fold_sql, messages, questions, records, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- retrieval -------------------------------------------------------------------------------------------------------

_QUERIES_SQL = """queries AS (
  SELECT c.row_seq AS query_id, c.document AS text, e.embedding::DOUBLE[] AS q
  FROM corpus c JOIN embeddings e ON e.vec_id = c.row_seq WHERE c.row_seq % 50 = 0)"""
_VECTOR_SQL = """near AS (
  SELECT query_id, id, content_kind, round(1 - list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))), 6) + 0.0 AS distance
  FROM queries, (SELECT c.id, c.content_kind, e.embedding::DOUBLE[] AS v FROM corpus c JOIN embeddings e ON e.vec_id = c.row_seq))"""
_TERMS = "list_filter(string_split_regex({}, '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: t <> '')"
_BM25_SQL = f"""toks AS (SELECT id, {_TERMS.format(fold_sql('document'))} AS t FROM corpus),
  totals AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks),
  posts AS (SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY term, id),
  dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
  qterms AS (SELECT DISTINCT query_id, unnest({_TERMS.format(fold_sql('substr(text, 1, 4000)'))}) AS term FROM queries),
  scored AS (
    SELECT query_id, p.id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
    FROM qterms JOIN posts p USING (term) JOIN dfs USING (term), totals GROUP BY query_id, p.id)"""
_EXACT_SQL = """keys AS (SELECT query_id, regexp_extract(text, '\\b\\d{6,}\\b') AS key FROM queries),
  exacts AS (SELECT query_id, id FROM keys JOIN corpus ON key <> '' AND contains(document, key))"""


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = corpus(spark, sf_dir, vectors=True)
    asked = chunks.filter((F.col("row_seq") % 50 == 0) & F.col("embedding").isNotNull()).select(F.col("row_seq").alias("query_id"), F.col("document").alias("text"), "embedding")
    return chunks, asked


@query(f"WITH {CORPUS_SQL} SELECT id, source, page, content_kind FROM corpus WHERE content_kind = 'instruction_text' AND page = '3'")
def metadata_filter(spark, sf_dir):
    return search.of_kind(corpus(spark, sf_dir), "instruction_text").filter("page = '3'").select("id", "source", "page", "content_kind")


@query(f"""WITH {CORPUS_SQL}, {_QUERIES_SQL}, {_VECTOR_SQL}
SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near) WHERE rank <= 200""")
def vector_topk(spark, sf_dir):
    return search.vector_candidates(*_searched(spark, sf_dir), search.CANDIDATES)


@query(f"""WITH {CORPUS_SQL}, {_QUERIES_SQL}, {_BM25_SQL}
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 200""")
def keyword_topk_bm25(spark, sf_dir):
    return search.keyword_candidates(corpus(spark, sf_dir), _searched(spark, sf_dir)[1], search.CANDIDATES)


#: What a stored index holds after a third of the chunks was left out, half of all were added or replaced, and a seventh deleted.
_CHANGED_SQL = """changed AS (SELECT id, CASE WHEN row_seq % 2 = 0 THEN 'new ' || document || ' end' ELSE document END AS document FROM corpus WHERE (row_seq % 3 <> 0 OR row_seq % 2 = 0) AND row_seq % 7 <> 0)"""


@query(f"""WITH {CORPUS_SQL}, {_QUERIES_SQL}, {_CHANGED_SQL}, {_BM25_SQL.replace("FROM corpus", "FROM changed")}
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 50""")
def keyword_after_changes(spark, sf_dir):
    chunks, asked = corpus(spark, sf_dir), _searched(spark, sf_dir)[1]
    index = fulltext.built(chunks.filter("row_seq % 3 <> 0").select("id", "document"))
    index.upsert(chunks.filter("row_seq % 2 = 0").select("id", F.concat(F.lit("new "), "document", F.lit(" end")).alias("document")))
    index.delete(chunks.filter("row_seq % 7 = 0").select("id"))
    return index.search(asked.select("query_id", "text"), 50)


@query(f"""WITH {CORPUS_SQL}, queries AS (SELECT row_seq AS query_id, document AS text FROM corpus), {_EXACT_SQL}
SELECT query_id, id FROM exacts""")
def exact_id_match(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    return search.exact_matches(chunks, chunks.select(F.col("row_seq").alias("query_id"), F.col("document").alias("text")))


def _hybrid_sql(keywords: bool, kind: str | None = None, final: str | None = None) -> str:
    where = f"WHERE content_kind = '{kind}'" if kind else ""
    kr = "1.0::DOUBLE / (60 + coalesce(kr, 9999)) + " if keywords else ""
    union = "UNION SELECT query_id, id FROM k" if keywords else ""
    k = f"""k AS (SELECT * FROM (SELECT query_id, s.id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.id) AS kr FROM scored s JOIN corpus c ON c.id = s.id {where}) WHERE kr <= 200)""" if keywords else "k AS (SELECT NULL::BIGINT AS query_id, NULL::VARCHAR AS id, NULL::BIGINT AS kr WHERE false)"
    ranked = "SELECT query_id, id, distance, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused)"
    last = final or f"{ranked} WHERE rank <= 10"
    if final == "hits":
        last = f""", hits AS (SELECT query_id, c.*, rank FROM ({ranked} WHERE rank <= 50) JOIN corpus c USING (id))"""
    return f"""WITH {CORPUS_SQL}, {_QUERIES_SQL}, {_VECTOR_SQL}, {_BM25_SQL}, {_EXACT_SQL},
  v AS (SELECT * FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS vr FROM near {where}) WHERE vr <= 200),
  {k},
  e AS (SELECT x.query_id, x.id FROM exacts x JOIN corpus c ON c.id = x.id {where}),
  cand AS (SELECT query_id, id FROM v UNION SELECT query_id, id FROM e {union}),
  fused AS (
    SELECT c.query_id, c.id, coalesce(distance, 1.7976931348623157e308) AS distance,
      round(1.0::DOUBLE / (60 + coalesce(vr, 9999)) + {kr}(CASE WHEN e.id IS NULL THEN 0 ELSE 10000.0::DOUBLE END), 9) AS score
    FROM cand c LEFT JOIN v ON v.query_id = c.query_id AND v.id = c.id LEFT JOIN k ON k.query_id = c.query_id AND k.id = c.id LEFT JOIN e ON e.query_id = c.query_id AND e.id = c.id)
  {last}"""


@query(_hybrid_sql(True, final="SELECT query_id, id FROM cand"))
def candidate_union(spark, sf_dir):
    chunks, asked = _searched(spark, sf_dir)
    return search.candidates(chunks, asked, index=fulltext.built(corpus(spark, sf_dir), asked)).select("query_id", "id")


@query(_hybrid_sql(True, "instruction_text"))
def hybrid_rrf(spark, sf_dir):
    chunks, asked = _searched(spark, sf_dir)
    return search.hybrid(chunks, asked, top_k=10, kind="instruction_text", index=fulltext.built(corpus(spark, sf_dir), asked))


@query(_hybrid_sql(False))
def vector_only_rrf(spark, sf_dir):
    return search.hybrid(*_searched(spark, sf_dir), top_k=10, keywords=False)


# --- expansion -------------------------------------------------------------------------------------------------------

#: Hits of each 50th document: the 50 best chunks of instructions.
_HITS_SQL = _hybrid_sql(False, "instruction_text", "hits").removeprefix("WITH ")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = _searched(spark, sf_dir)
    found = search.hybrid(chunks, asked, top_k=50, kind="instruction_text", keywords=False).select("query_id", "id", "rank")
    return stable(found, "hits").join(corpus(spark, sf_dir), "id")  # searched once, however often they are read


_RELATED_SQL = f"""WITH {_HITS_SQL},
  places AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, source, page NULLS FIRST, slide NULLS FIRST) AS n
    FROM (SELECT query_id, source, page, slide, min(rank) AS first FROM hits GROUP BY ALL)) WHERE n <= 20),
  met AS (SELECT DISTINCT query_id, c.id, c.row_seq FROM corpus c JOIN places p ON c.source = p.source AND (c.page = p.page OR c.slide = p.slide) WHERE c.content_kind = 'image_ui_description')
SELECT query_id, id, row_seq FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY row_seq) AS n FROM met) WHERE n <= 10"""


@query(_RELATED_SQL)
def related_chunks(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    return expansion.related(chunks, _hits(spark, sf_dir), "image_ui_description", 10).select("query_id", "id", "row_seq")


@query(f"""WITH {CORPUS_SQL}, wanted AS (SELECT query_id, any_value(action_kind) AS action, any_value(source) AS source FROM (SELECT row_seq AS query_id, action_kind, source FROM corpus WHERE row_seq % 50 = 0 AND action_kind IS NOT NULL) GROUP BY query_id)
SELECT query_id, id, position FROM (
  SELECT query_id, c.id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(slide AS INT) NULLS FIRST, CAST(chunk_index AS INT) NULLS FIRST, row_seq) AS position
  FROM corpus c JOIN wanted w ON c.source IN (w.source, 'src1') AND c.action_kind = w.action
  WHERE content_kind = 'instruction_text' AND instruction_role = 'procedure_steps') WHERE position <= 12""")
def procedure_chunks(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    wanted = chunks.filter("row_seq % 50 = 0 and action_kind is not null").select(F.col("row_seq").alias("query_id"), F.col("action_kind").alias("action"), F.concat(F.array(F.lit(None).cast("string"), F.lit(" ")), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("other"), i.cast("string"))), F.array("source", F.upper("source"), F.lit("src1"))).alias("sources"))
    return expansion.procedures(chunks, wanted)  # of ten sources that count the two last ones exist


@query(_RELATED_SQL.replace("SELECT query_id, id, row_seq FROM (SELECT *", ", more AS (SELECT query_id, id, row_seq FROM (SELECT *") + f"""),
  staged AS (SELECT query_id, rank AS position, id, document, 0 AS stage FROM hits UNION ALL SELECT query_id, m.row_seq, m.id, c.document, 1 FROM more m JOIN corpus c USING (id) WHERE trim(c.document) <> ''),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, {fold_sql('document')} ORDER BY stage, position, id) AS n FROM staged)
SELECT query_id, id, stage, row_number() OVER (PARTITION BY query_id ORDER BY stage, position, id) AS place FROM firsts WHERE stage = 0 OR n = 1""")
def append_related(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    base = hits.select("query_id", F.col("rank").cast("long").alias("position"), "id", "document")
    more = expansion.related(corpus(spark, sf_dir), hits, "image_ui_description", 10).select("query_id", F.col("row_seq").alias("position"), "id", "document")
    return expansion.append_new(base, more).select("query_id", "id", "stage", "place")


@query(f"""WITH {_HITS_SQL}
SELECT query_id, source, page, id, rank FROM (SELECT query_id, source, coalesce(page, slide) AS page, id, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM hits) WHERE n = 1""")
def citations(spark, sf_dir):
    return expansion.citations(_hits(spark, sf_dir))


_WORDS_CTE = "words(action, word) AS (VALUES " + ", ".join(f"('{a}', '{w}')" for a, w in intent.ACTION_WORDS.items()) + ")"


def _kind_sql(folded: str) -> str:
    whens = []
    for phrase in sorted(intent.ACTIONS, key=len, reverse=True):
        pattern = "\\bin\\b" if phrase == "in" else f"(^|\\s){phrase}(\\s|$)"
        whens.append(f"WHEN regexp_matches({folded}, '{pattern}') THEN '{intent.ACTIONS[phrase]}'")
    return "CASE " + " ".join(whens) + " END"


@query(f"""WITH {CORPUS_SQL}, {MESSAGES_SQL}, {_WORDS_CTE},
  asked AS (SELECT query_id AS message_id, {_kind_sql(fold_sql('text'))} AS action, {{intent}} = 'TaskInstruction' AS task FROM messages),
  chunks AS (SELECT *, coalesce(action_kind, {_kind_sql(fold_sql('slide_title'))}) AS own FROM corpus),
  heads AS (SELECT id, {fold_sql("unnest(list_filter(string_split_regex(document, '[\\r\\n]'), lambda p: p <> '')[1:3])")} AS line FROM chunks WHERE own IS NULL),
  named AS (SELECT DISTINCT id, words.action FROM heads, words WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}])' || word || '([^\\p{{L}}\\p{{N}}]|$)')),
  lists AS (SELECT id, list(action) AS names FROM named GROUP BY id),
  pairs AS (SELECT message_id, a.action, task, c.id, c.row_seq AS rank, instruction_role,
      CASE WHEN own IS NOT NULL THEN own = a.action ELSE coalesce(list_contains(names, a.action), false) END AS same,
      CASE WHEN own IS NOT NULL THEN own <> a.action ELSE coalesce(len(list_filter(names, lambda x: x <> a.action)) > 0, false) END AS other
    FROM asked a, chunks c LEFT JOIN lists USING (id)),
  met AS (SELECT *, CASE WHEN action IS NULL THEN 2 WHEN same THEN CASE WHEN instruction_role = 'procedure_steps' THEN 0 ELSE 1 END WHEN other THEN 4 ELSE 2 END AS priority FROM pairs),
  best AS (SELECT *, min(priority) OVER (PARTITION BY message_id) AS best FROM met)
SELECT message_id, id, priority, row_number() OVER (PARTITION BY message_id ORDER BY priority, rank) AS place FROM best WHERE NOT (action IS NOT NULL AND task AND best = 0 AND priority = 4)""")
def action_rerank(spark, sf_dir):
    chunks = expansion.with_actions(corpus(spark, sf_dir)).select("id", F.col("row_seq").alias("rank"), "instruction_role", "actions")
    hits = chunks.crossJoin(F.broadcast(messages(spark).select("query_id")))  # the messages are a fixed list
    return expansion.rerank(hits, messages(spark)).withColumnRenamed("query_id", "message_id")


# --- changes ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {CORPUS_SQL}, base AS (SELECT * FROM corpus WHERE row_seq % 3 <> 0),
  incoming AS (SELECT id, row_seq AS position, 'new ' || document AS document FROM corpus WHERE row_seq % 2 = 0 UNION ALL SELECT id, row_seq + 1000000000, 'again ' || id FROM corpus WHERE row_seq % 8 = 0),
  latest AS (SELECT id, max(position) AS position, arg_max(document, position) AS document FROM incoming GROUP BY id),
  fresh AS (SELECT id, (SELECT max(row_seq) FROM base) + row_number() OVER (ORDER BY position, id) AS row_seq, document FROM latest WHERE id NOT IN (SELECT id FROM base))
SELECT id, row_seq, md5(document) AS digest FROM fresh UNION ALL SELECT b.id, b.row_seq, md5(coalesce(l.document, b.document)) FROM base b LEFT JOIN latest l ON l.id = b.id""")
def upsert_chunks(spark, sf_dir):
    chunks = corpus(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    fields = ["id", "document", "metadata", "embedding", "position"]
    first = chunks.filter("row_seq % 2 = 0").withColumn("document", F.concat(F.lit("new "), "document")).withColumn("position", F.col("row_seq")).select(fields)
    again = chunks.filter("row_seq % 8 = 0").withColumn("document", F.concat(F.lit("again "), "id")).withColumn("position", F.col("row_seq") + 1000000000).select(fields)
    changed = upsert(chunks.filter("row_seq % 3 <> 0"), first.unionByName(again))
    return changed.select("id", "row_seq", F.md5("document").alias("digest"))


@query(f"WITH {CORPUS_SQL} SELECT id, source FROM corpus WHERE NOT coalesce(relative_path = 'files/src1.pptx' OR source = 'src2', false)")
def delete_by_metadata(spark, sf_dir):
    return delete(corpus(spark, sf_dir), "files/src1.pptx", "src2").select("id", "source")


# --- text ------------------------------------------------------------------------------------------------------------

_ALL_TEXTS = f"""{MESSAGES_SQL}, texts AS (SELECT doc_id AS key, text FROM documents UNION ALL SELECT -1 - query_id, text FROM messages)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text").unionAll(messages(spark).select((-1 - F.col("query_id")).cast("long"), "text"))


@query(f"WITH {_ALL_TEXTS} SELECT key, md5({fold_sql('text')}) AS folded FROM texts")
def fold_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("key", F.md5(text.fold(F.col("text"))).alias("folded"))


_LINES = "unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) AS pos"
_USEFUL = "trim(line) <> '' AND regexp_matches(line, '[\\p{L}\\p{Nd}]') AND NOT regexp_matches(line, '\\\\begin|\\\\end|\\\\\\[|\\\\\\]')"


@query(f"""WITH {_ALL_TEXTS}, split AS (SELECT key, {_LINES} FROM texts),
  ranked AS (SELECT key, pos, trim(line) AS line, row_number() OVER (PARTITION BY key, {fold_sql('line')} ORDER BY pos) AS n FROM split WHERE {_USEFUL}),
  kept AS (SELECT key, string_agg(line, chr(10) ORDER BY pos) AS cleaned FROM ranked WHERE n <= 2 GROUP BY key)
SELECT t.key, md5(coalesce(cleaned, '')) AS cleaned FROM texts t LEFT JOIN kept USING (key)""")
def clean_lines(spark, sf_dir):
    return _texts(spark, sf_dir).select("key", F.md5(text.clean_lines(F.col("text"))).alias("cleaned"))


@query(f"""WITH split AS (SELECT source, doc_id, {_LINES} FROM documents),
  ranked AS (SELECT source, doc_id, pos, trim(line) AS line, row_number() OVER (PARTITION BY source, {fold_sql('line')} ORDER BY doc_id, pos) AS n FROM split WHERE {_USEFUL}),
  kept AS (SELECT source, doc_id, string_agg(line, chr(10) ORDER BY pos) AS cleaned FROM ranked WHERE n <= 2 GROUP BY source, doc_id)
SELECT d.source, d.doc_id, md5(coalesce(cleaned, '')) AS cleaned FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id""")
def cross_chunk_line_cap(spark, sf_dir):
    capped = chunking.cap_lines(table(spark, sf_dir, "documents"), "source", "doc_id", "doc_id", "text")
    return capped.select("source", "doc_id", F.md5("cleaned").alias("cleaned"))


@query(f"""WITH {CORPUS_SQL},
  sets AS (SELECT content_kind, id, slide_title, action_kind, list_distinct(list_transform(list_filter(string_split_regex(document, '\\r\\n|\\r|\\n'), lambda x: trim(x) <> ''), lambda x: {fold_sql('x')})) AS l FROM corpus WHERE content_kind = 'instruction_text'),
  pairs AS (SELECT a.content_kind, a.id AS a, b.id AS b, len(list_intersect(a.l, b.l)) AS shared, len(a.l) AS n, len(b.l) AS m,
      a.slide_title IS DISTINCT FROM b.slide_title OR a.action_kind IS DISTINCT FROM b.action_kind AS differ
    FROM sets a JOIN sets b ON a.id < b.id WHERE len(a.l) >= 4 AND len(b.l) >= 4)
SELECT content_kind, a, b, shared, n, m FROM pairs WHERE differ AND shared >= 0.8 * greatest(n, m)""")
def near_dup_pairs(spark, sf_dir):
    chunks = corpus(spark, sf_dir).filter("content_kind = 'instruction_text'")
    pairs = chunking.near_duplicate_pairs(chunks, "content_kind")
    left = chunks.select(F.col("id").alias("a"), F.col("slide_title").alias("ta"), F.col("action_kind").alias("ka"))
    right = chunks.select(F.col("id").alias("b"), F.col("slide_title").alias("tb"), F.col("action_kind").alias("kb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(~(F.col("ta").eqNullSafe(F.col("tb")) & F.col("ka").eqNullSafe(F.col("kb")))).select("content_kind", "a", "b", "shared", "n", "m")


_LINE_SETS = f"""sets AS (SELECT source, doc_id, list_sort(list_distinct(list_transform(list_filter(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: trim(x) <> ''), lambda x: {fold_sql('x')}))) AS l FROM documents)"""


@query(f"""WITH {_LINE_SETS}, long AS (SELECT source, doc_id, l FROM sets WHERE len(l) >= 4)
SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source, l) AS class_key, len(l) AS n_lines FROM long""")
def near_dup_classes(spark, sf_dir):
    return chunking.near_duplicate_classes(table(spark, sf_dir, "documents"), key="doc_id", text="text").select("source", "doc_id", "class_key", F.col("n_lines").cast("long").alias("n_lines"))


@query(f"""WITH {_LINE_SETS}, heads AS (SELECT source, min(doc_id) AS doc_id, l FROM sets WHERE len(l) >= 4 GROUP BY source, l)
SELECT a.source, a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.l, b.l)) AS shared, len(a.l) AS n, len(b.l) AS m
FROM heads a JOIN heads b ON a.source = b.source AND a.doc_id < b.doc_id WHERE len(list_intersect(a.l, b.l)) >= 0.8 * greatest(len(a.l), len(b.l))""")
def near_dup_links(spark, sf_dir):
    return chunking.near_duplicate_links(table(spark, sf_dir, "documents"), key="doc_id", text="text")[1].select("source", "a", "b", *(F.col(c).cast("long").alias(c) for c in ("shared", "n", "m")))


_CHUNKS_CTE = """walk(key, text, n, start0, taken, done, no) AS (
    SELECT key, text, length(text), 0, 0, false, -1 FROM texts WHERE length(text) > 600 AND regexp_matches(text, '\\S')
    UNION ALL
    SELECT key, text, n, start, tk, start + tk >= n, no + 1 FROM (
      SELECT *, CASE WHEN NOT last AND back > 0 AND start + target - back > start AND target - back >= 225 THEN target - back ELSE target END AS tk FROM (
        SELECT *, start + target >= n AS last, strpos(reverse(substr(text, start + target - 100 + 1, 100)), ' ') AS back FROM (
          SELECT *, least(600, n - start) AS target FROM (
            SELECT *, CASE WHEN no < 0 THEN 0 ELSE start0 + greatest(taken - 100, 125) END AS start FROM walk WHERE NOT done))))
  ),
  pieces AS (SELECT key, no, trim(regexp_replace(substr(text, start0 + 1, taken), '^\\s+|\\s+$', '', 'g')) AS chunk FROM walk WHERE no >= 0
    UNION ALL SELECT key, 0, text FROM texts WHERE length(text) <= 600 AND regexp_matches(text, '\\S')),
  numbered AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY no) - 1 AS chunk_no, chunk FROM pieces WHERE chunk <> '')"""


@query(f"WITH RECURSIVE {_ALL_TEXTS}, {_CHUNKS_CTE} SELECT key, chunk_no, md5(chunk) AS digest FROM numbered")
def chunk_split(spark, sf_dir):
    return chunking.split_documents(_texts(spark, sf_dir), text="text").select("key", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk").alias("digest"))


@query("""SELECT event_id, sha256('user' || user_id || '|' || CAST(621355968000000000 + epoch_us(ts) * 10 AS VARCHAR) || '|' || length(props)) || '_chunk_' || (event_id % 5) AS chunk_id FROM events""")
def chunk_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    made = text.chunk_id(F.concat(F.lit("user"), "user_id"), F.col("ts").cast("timestamp"), F.length("props"), F.col("event_id") % 5)
    return e.select("event_id", made.alias("chunk_id"))


@query(f"""WITH RECURSIVE texts AS (SELECT doc_id AS key, text, source FROM documents), {_CHUNKS_CTE}
SELECT source, key, chunk_no, row_number() OVER (PARTITION BY source ORDER BY key, chunk_no) - 1 AS chunk_index FROM numbered JOIN texts USING (key)""")
def global_chunk_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", "source")
    numbered = chunking.number_chunks(chunking.split_documents(docs, text="text"), "source", ("key", "chunk_no"))
    return numbered.select("source", "key", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("chunk_index").cast("long").alias("chunk_index"))


@query(f"""WITH {_ALL_TEXTS} SELECT key, len(regexp_extract_all(text, '(?i)\\b(?:Bước|Buoc|B)\\s*\\d+\\s*:')) AS steps,
  regexp_matches(text, '(?i)^\\s*(?:Bước|Buoc|Step|B)\\s*\\d+\\b') AS is_step FROM texts""")
def count_steps(spark, sf_dir):
    t = F.col("text")
    return _texts(spark, sf_dir).select("key", text.count_steps(t).cast("long").alias("steps"), text.is_step_line(t).alias("is_step"))


@query(f"""WITH {_ALL_TEXTS}, first AS (SELECT key, text, len(regexp_extract_all(text, '(?i)\\b(?:Bước|Buoc|B)\\s*\\d+\\s*:')) AS steps, len(regexp_extract_all(text, '(?i)\\b(?:Bước|Buoc|B)\\s*1\\s*:')) AS starts FROM texts),
  marked AS (SELECT key, string_split(regexp_replace(text, '(?i)\\b((?:Bước|Buoc|B)\\s*1\\s*:)', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM first WHERE steps > 0 AND starts > 1)
SELECT key, generate_subscripts(parts[2:], 1) - 1 AS block_no, trim(regexp_replace(unnest(parts[2:]), '^\\s+|\\s+$', '', 'g')) AS block FROM marked
UNION ALL SELECT key, 0, trim(text) FROM first WHERE steps > 0 AND starts <= 1""")
def split_blocks(spark, sf_dir):
    found = _texts(spark, sf_dir).select("key", F.posexplode(text.procedure_blocks(F.col("text"))).alias("block_no", "block"))
    return found.select("key", F.col("block_no").cast("long").alias("block_no"), "block")


@query(f"WITH {_ALL_TEXTS} SELECT key, nullif(regexp_extract(text, '\\b\\d{{6,}}\\b'), '') AS identifier FROM texts")
def identifier(spark, sf_dir):
    return _texts(spark, sf_dir).select("key", text.identifier(F.col("text")).alias("identifier"))


# --- classification --------------------------------------------------------------------------------------------------


def _any_sql(folded: str, words: list[str]) -> str:
    return f"regexp_matches({folded}, '(^|[^\\p{{L}}\\p{{N}}])(" + "|".join(words) + ")([^\\p{L}\\p{N}]|$)')"


def _intent_sql(x: str) -> str:
    folded = fold_sql(x)
    masked = f"regexp_replace(regexp_replace(replace({folded}, ' ', '  '), '(^|[^\\p{{L}}\\p{{N}}])(dao  tao|bat  buoc)([^\\p{{L}}\\p{{N}}]|$)', '\\1#\\3', 'g'), ' +', ' ', 'g')"
    free = [w for w in intent.TASK_KEYWORDS if w not in intent.EXCLUDED]
    task = f"({_any_sql(folded, free)} OR {_any_sql(masked, list(intent.EXCLUDED))})"
    ui = _any_sql(folded, intent.UI_KEYWORDS)
    return f"CASE WHEN {task} AND NOT {ui} THEN 'TaskInstruction' WHEN {ui} AND NOT {task} THEN 'UiLocation' ELSE 'General' END"


SQL["action_rerank"] = SQL["action_rerank"].replace("{intent}", _intent_sql("text"))


@query(f"WITH {_ALL_TEXTS} SELECT key, {_intent_sql('text')} AS intent FROM texts")
def query_intent(spark, sf_dir):
    return _texts(spark, sf_dir).select("key", intent.query_intent(F.col("text")).alias("intent"))


@query(f"WITH {_ALL_TEXTS} SELECT key, {_kind_sql(fold_sql('text'))} AS action FROM texts")
def action_kind(spark, sf_dir):
    return _texts(spark, sf_dir).select("key", intent.action_kind(F.col("text")).alias("action"))


@query("""SELECT event_type, CASE lower(trim(kind)) WHEN 'phe_duyet' THEN 'duyet' ELSE nullif(lower(trim(kind)), '') END AS kind, count(*) AS n
FROM (SELECT event_type, unnest([event_type, ' Phe_Duyet ', 'DUYET', ' ', upper(event_type)]) AS kind FROM events) GROUP BY ALL""")
def canonical_action(spark, sf_dir):
    kinds = F.explode(F.array(F.col("event_type"), F.lit(" Phe_Duyet "), F.lit("DUYET"), F.lit(" "), F.upper("event_type")))
    return table(spark, sf_dir, "events").select("event_type", kinds.alias("k")).select("event_type", intent.canonical_action(F.col("k")).alias("kind")).groupBy("event_type", "kind").agg(F.count("*").alias("n"))


def _lookup_sql(x: str) -> str:
    return f"(regexp_matches({x}, '\\b\\d{{6,}}\\b') OR " + " OR ".join(f"contains({fold_sql(x)}, '{w}')" for w in intent.LOOKUP_WORDS) + ")"


@query(f"""WITH {_ALL_TEXTS} SELECT key, least(CASE WHEN {_lookup_sql('text')} THEN 100 WHEN {_kind_sql(fold_sql('text'))} IS NOT NULL OR {_intent_sql('text')} = 'TaskInstruction' THEN 20 ELSE 3 END, 50) AS top_k,
  {fold_sql('text')} IN ({", ".join(f"'{g}'" for g in intent.GREETINGS)}) AS greeting FROM texts""")
def topk_policy(spark, sf_dir):
    t = F.col("text")
    return _texts(spark, sf_dir).select("key", intent.top_k(t).alias("top_k"), intent.is_greeting(t).alias("greeting"))


@query(f"""WITH {_ALL_TEXTS}, counted AS (SELECT key, len(regexp_extract_all(text, '(?i)\\b(?:Bước|Buoc|B)\\s*\\d+\\s*:')) AS n FROM texts)
SELECT key, CASE WHEN n > 0 THEN least(greatest(600 + n * 120, 900), 1800) ELSE 600 END AS tokens FROM counted""")
def token_policy(spark, sf_dir):
    return _texts(spark, sf_dir).select("key", intent.answer_tokens(F.col("text")).alias("tokens"))


@query("""SELECT event_id, CASE WHEN small AND (ocr IS NULL OR trim(ocr) = '' OR length(ocr) <= 50) THEN 'InlineIcon' WHEN NOT small THEN 'UiScreenshot' ELSE 'UnknownImage' END AS role,
  least(w, h) < 20 OR greatest(w, h) / least(w, h)::DOUBLE > 15 AS skipped
FROM (SELECT *, w < 160 OR h < 90 AS small FROM (SELECT event_id, 1 + event_id % 400 AS w, 1 + user_id % 300 AS h, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN props ELSE repeat(props, 4) END AS ocr FROM events))""")
def image_role(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sized = e.select("event_id", (1 + F.col("event_id") % 400).alias("w"), (1 + F.col("user_id") % 300).alias("h"), F.when(F.col("event_id") % 3 == 1, F.col("props")).when(F.col("event_id") % 3 == 2, F.repeat("props", F.lit(4))).alias("ocr"))
    w, h = F.col("w"), F.col("h")
    return sized.select("event_id", generated.image_role(w, h, F.col("ocr"), 160, 90).alias("role"), generated.skip_recognition(w, h).alias("skipped"))


def _most_sql(values: str) -> str:
    return f"coalesce(list_max(list_transform(list_distinct({values}), lambda y: len(list_filter({values}, lambda z: z = y)))), 0)"


@query(f"""WITH {_ALL_TEXTS}, captions AS (SELECT key, text || CASE WHEN key % 2 = 0 THEN ' button table' ELSE '' END AS c FROM texts),
  parts AS (SELECT key, c, {fold_sql('c')} AS f, regexp_replace(c, '\\s+', '', 'g') AS compact,
    list_filter(list_transform(string_split_regex(c, '\\r\\n|\\r|\\n'), lambda x: {fold_sql('x')}), lambda x: length(x) > 12) AS l FROM captions),
  tokens AS (SELECT *, list_filter(string_split(f, ' '), lambda t: t <> '') AS t FROM parts),
  toplines AS (SELECT key, max(n) AS most FROM (SELECT key, x, count(*) AS n FROM (SELECT key, unnest(l) AS x FROM parts) GROUP BY ALL) GROUP BY key),
  toptokens AS (SELECT key, max(n) AS most FROM (SELECT key, x, count(*) AS n FROM (SELECT key, unnest(t) AS x FROM tokens) GROUP BY ALL) GROUP BY key),
  counted AS (SELECT p.*, coalesce(tl.most, 0) AS ml, coalesce(tt.most, 0) AS mt, length(regexp_replace(compact, '[^\\p{{Nd}}]', '', 'g')) AS digits, length(regexp_replace(c, '[^\\p{{L}}]', '', 'g')) AS letters
    FROM tokens p LEFT JOIN toplines tl USING (key) LEFT JOIN toptokens tt USING (key))
SELECT key, trim(c) <> '' AND length(f) >= 40 AND length(c) - length(replace(c, '?', '')) < 5 AND NOT regexp_matches(c, '[\\x{{4E00}}-\\x{{9FFF}}]')
  AND NOT ({" OR ".join(f"contains(f, '{p}')" for p in generated.PLACEHOLDERS)}) AND NOT (len(l) >= 4 AND ml >= 3)
  AND NOT (len(t) >= 20 AND (mt >= 12 OR mt >= len(t) * 0.45::DOUBLE))
  AND NOT (length(compact) >= 120 AND ((digits > letters * 3 AND regexp_matches(compact, '(?:\\d[\\d.,]*){{80,}}')) OR regexp_matches(compact, '(?:0{{8,}}|0001|0002|\\.000){{8,}}')))
  AND ({" OR ".join(f"contains(f, '{p}')" for p in generated.EVIDENCE)}) AND letters >= 20 AS useful FROM counted""")
def caption_quality(spark, sf_dir):
    captions = _texts(spark, sf_dir).select("key", F.concat("text", F.when(F.col("key") % 2 == 0, " button table").otherwise("")).alias("c"))
    return captions.select("key", generated.caption_is_useful(F.col("c")).alias("useful"))


@query(f"""WITH {_ALL_TEXTS}, l AS (SELECT key, {fold_sql('line')} AS x FROM (SELECT key, unnest(string_split_regex(text, '[\\r\\n]')) AS line FROM texts)),
  most AS (SELECT key, max(n) AS n FROM (SELECT key, x, count(*) AS n FROM l WHERE x <> '' GROUP BY ALL) GROUP BY key)
SELECT t.key, coalesce(n, 0) >= 3 AS repeats FROM texts t LEFT JOIN most USING (key)""")
def repetition_lines(spark, sf_dir):
    return _texts(spark, sf_dir).select("key", generated.repeats_lines(F.col("text")).alias("repeats"))


@query(f"""WITH {_ALL_TEXTS}, l AS (SELECT key, {fold_sql('line')} AS x FROM (SELECT key, unnest(string_split_regex(text, '[\\r\\n]')) AS line FROM texts)),
  most AS (SELECT key, max(n) AS n FROM (SELECT key, x, count(*) AS n FROM l WHERE x <> '' GROUP BY ALL) GROUP BY key),
  s AS (SELECT key, text, {fold_sql('text')} AS f, right({fold_sql('text')}, 40) AS tail,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {fold_sql('x')}), lambda x: length(x) >= 35) AS s FROM texts)
SELECT s.key, coalesce(length(text) >= 100 AND (coalesce(n, 0) >= 3 OR len(s) >= 4 AND len(list_filter(s, lambda x: x = s[-1])) >= 3 OR length(f) >= 80 AND strpos(substr(f, strpos(f, tail) + 40), tail) > 0), false) AS loops
FROM s LEFT JOIN most USING (key)""")
def repetition_loop(spark, sf_dir):
    return _texts(spark, sf_dir).select("key", generated.is_repetition_loop(F.col("text")).alias("loops"))


# --- records ---------------------------------------------------------------------------------------------------------

_FIELDS_CTE = f"""quoted AS (SELECT record_id, string_split(text, '"') AS q FROM records),
  rejoined AS (SELECT record_id, array_to_string(list_transform(q, lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, ',', chr(1)) ELSE x END), '"') AS t FROM quoted),
  parts AS (SELECT record_id, trim(unnest(string_split(t, chr(1)))) AS p, generate_subscripts(string_split(t, chr(1)), 1) AS pos FROM rejoined),
  pairs AS (SELECT record_id, pos, {fold_sql("split_part(p, ':', 1)")} AS key, trim(substr(p, strpos(p, ':') + 1)) AS value FROM parts WHERE strpos(p, ':') > 1 AND strpos(p, ':') < length(p)),
  fields AS (SELECT record_id, pos, key, value FROM (SELECT *, row_number() OVER (PARTITION BY record_id, key ORDER BY pos) AS n FROM pairs WHERE key <> '') WHERE n = 1)"""


@query(f"WITH {RECORDS_SQL}, {_FIELDS_CTE} SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY pos) - 1 AS field_no, key, value FROM fields")
def structured_rows(spark, sf_dir):
    found = records(spark, sf_dir).select("record_id", F.posexplode(structured.fields(F.col("text"))).alias("field_no", "f"))
    return found.select("record_id", F.col("field_no").cast("long").alias("field_no"), "f.key", "f.value")


def _field_sql(name: str) -> str:
    exact = ", ".join(f"list_filter(f, lambda x: x.key = '{a}')[1].value" for a in structured.FIELDS[name])
    return f"coalesce({exact}, list_filter(f, lambda x: {' OR '.join(f"contains(x.key, '{a}')" for a in structured.FIELDS[name])})[1].value)"


def _words_sql(folded: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({folded}, '{w}')" for w in words) + ")"


_TAIL = "\\s+(.+?)(?:\\s+(?:là|la)\\s+gì|[?？])?$"
_ANSWERS_SQL = f"""lists AS (SELECT record_id, list(struct_pack(key, value) ORDER BY pos) AS f FROM fields GROUP BY record_id),
  found AS (SELECT record_id, {", ".join(f"{_field_sql(n)} AS {n}" for n in structured.FIELDS)} FROM lists),
  people AS (SELECT record_id, student_id, coalesce(full_name, nullif(concat_ws(' ', nullif(trim(last_name), ''), nullif(trim(first_name), '')), '')) AS full_name, email, class_name FROM found),
  said AS (SELECT *, {fold_sql('text')} AS folded, nullif(regexp_extract(text, '\\b\\d{{6,}}\\b'), '') AS number, trim(regexp_extract(text, '(?i)(?:email|mail|thư điện tử)\\s+(?:của|cua){_TAIL}', 1)) AS mail,
    trim(regexp_extract(text, '(?i)(?:của|cua){_TAIL}', 1)) AS anyone FROM questions),
  named AS (SELECT *, CASE WHEN regexp_matches(folded, 'email|mail|thu dien tu|cua ai|la ai') THEN CASE WHEN mail <> '' THEN mail WHEN anyone <> '' AND {fold_sql('anyone')} NOT IN ('ai', 'ai vay') THEN anyone END END AS name FROM said),
  asked AS (SELECT *, {_words_sql('folded', structured.MAIL_WORDS)} AS asks_mail, {_words_sql('folded', structured.PERSON_WORDS)} OR number IS NOT NULL AS asks_person FROM named WHERE number IS NOT NULL OR name IS NOT NULL),
  met AS (SELECT a.*, p.* FROM asked a JOIN people p ON CASE WHEN number IS NOT NULL THEN lower(trim(student_id)) = lower(number) ELSE trim(full_name) <> '' AND contains({fold_sql('full_name')}, {fold_sql('name')}) END),
  replies AS (SELECT query_id, record_id, CASE WHEN asks_mail THEN CASE WHEN trim(email) <> '' THEN 'Email của ' || coalesce(full_name, name, '') || ' là ' || email || '.' ELSE '{structured.NO_MAIL}' END
    WHEN asks_person THEN coalesce(nullif(concat_ws(', ', {", ".join(f"'{label}' || CASE WHEN trim({n}) <> '' THEN {n} END" for n, label in structured.PARTS.items())}), '') || '.', '{structured.NOT_FOUND}') END AS answer FROM met),
  firsts AS (SELECT query_id, min(record_id) AS record_id, arg_min(answer, record_id) AS answer FROM replies WHERE answer IS NOT NULL GROUP BY query_id)
SELECT query_id, record_id, coalesce(answer, '{structured.NOT_FOUND}') AS answer FROM (SELECT DISTINCT query_id FROM asked) LEFT JOIN firsts USING (query_id)"""


@query(f"WITH {RECORDS_SQL}, {QUESTIONS_SQL}, {_FIELDS_CTE}, {_ANSWERS_SQL}")
def structured_answer(spark, sf_dir):
    return record_answers.answers(questions(spark, sf_dir), record_answers.people(records(spark, sf_dir)))


@query("""SELECT p_partkey AS key, nullif(concat_ws(', ', 'p_name: ' || nullif(trim(p_name), ''), 'p_brand: ' || nullif(trim(p_brand), ''), 'p_type: ' || nullif(trim(CASE WHEN p_partkey % 3 > 0 THEN p_type END), ''), 'p_size: ' || p_size), '') AS document, p_partkey + 1 AS row FROM part""")
def tabular_render(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    columns = [("p_name", F.col("p_name")), ("p_brand", F.col("p_brand")), ("p_type", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type"))), ("p_size", F.col("p_size").cast("string"))]
    return p.select(F.col("p_partkey").alias("key"), chunking.render_row(columns).alias("document"), (F.col("p_partkey") + 1).alias("row"))


# --- incremental -----------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  walk AS (SELECT user_id, event_id, ts, n, ts AS last, true AS taken FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.ts, e.n, CASE WHEN e.ts - w.last >= INTERVAL 6 HOUR THEN e.ts ELSE w.last END, e.ts - w.last >= INTERVAL 6 HOUR FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, ts FROM walk WHERE taken""")
def throttle(spark, sf_dir):
    return files.throttled(table(spark, sf_dir, "events"), 6 * 3600, path="user_id")


@query("""SELECT DISTINCT 'user' || user_id AS path, date_trunc('hour', ts) AS modified, length(props) AS length FROM events
EXCEPT SELECT 'user' || user_id, date_trunc('hour', ts), length(props) FROM events WHERE event_id % 4 = 0""")
def fingerprint_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("user"), "user_id").alias("path"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("modified"), F.length("props").cast("long").alias("length"))
    return files.unseen(e.select("path", "modified", "length"), e.filter("event_id % 4 = 0"))


@query("""WITH o AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, length(event_type) AS length, event_id % 2 AS modified FROM events),
  s AS (SELECT *, lag(length) OVER w = length AND lag(modified) OVER w = modified AS same FROM o WHERE attempt <= 5 WINDOW w AS (PARTITION BY path ORDER BY attempt))
SELECT path, min(attempt) AS attempt FROM s WHERE same GROUP BY path""")
def file_stability(spark, sf_dir):
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), attempt.cast("long").alias("attempt"), F.length("event_type").alias("length"), (F.col("event_id") % 2).alias("modified"))
    return files.stable(seen)


@query("""WITH RECURSIVE a AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_id % 5 = 0 AS ok FROM events),
  walk AS (SELECT path, attempt, CASE WHEN ok THEN 0 ELSE 1 END AS failures, CASE WHEN ok THEN 'done' ELSE 'retry' END AS action FROM a WHERE attempt = 1
    UNION ALL SELECT a.path, a.attempt, CASE WHEN ok THEN 0 WHEN w.action = 'drop' THEN 1 ELSE w.failures + 1 END, CASE WHEN ok THEN 'done' WHEN w.action <> 'drop' AND w.failures + 1 > 3 THEN 'drop' ELSE 'retry' END
    FROM walk w JOIN a ON a.path = w.path AND a.attempt = w.attempt + 1)
SELECT path, attempt, failures, action FROM walk""")
def retry_policy(spark, sf_dir):
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), attempt.cast("long").alias("attempt"), (F.col("event_id") % 5 == 0).alias("succeeded"))
    return files.retries(seen)


@query("""WITH t AS (SELECT conv_id, turn, turn * (CASE WHEN conv_id % 2 = 0 THEN 7 ELSE 4 END) AS minute, CASE WHEN turn % 3 = 2 THEN 'của ai' ELSE text || ' ' || (CASE WHEN turn % 4 = 0 THEN CAST(1000000 + conv_id AS VARCHAR) ELSE '' END) END AS text FROM conversations),
  k AS (SELECT *, nullif(regexp_extract(text, '\\b\\d{6,}\\b'), '') AS found, text = 'của ai' AS follows FROM t),
  g AS (SELECT *, last_value(CASE WHEN found IS NOT NULL OR follows THEN minute END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
  s AS (SELECT *, sum(CASE WHEN (found IS NOT NULL OR follows) AND (before IS NULL OR minute - before > 15) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS span FROM g),
  r AS (SELECT *, last_value(found IGNORE NULLS) OVER (PARTITION BY conv_id, span ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM s)
SELECT conv_id, turn, md5(CASE WHEN follows AND known IS NOT NULL THEN known || ' là của ai' ELSE text END) AS effective FROM r""")
def followup_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 3 == 2, "của ai").otherwise(F.concat("text", F.lit(" "), F.when(F.col("turn") % 4 == 0, (1000000 + F.col("conv_id")).cast("string")).otherwise("")))
    minute = F.col("turn") * F.when(F.col("conv_id") % 2 == 0, 7).otherwise(4)
    timed = c.select("conv_id", "turn", said.alias("text"), F.timestamp_seconds(minute * 60).alias("ts"))
    return expansion.resolve_follow_ups(timed).select("conv_id", "turn", F.md5("effective").alias("effective"))


@query("""WITH i AS (SELECT user_id AS file, event_id % 4 AS slide, event_id AS image_index, event_id % 3 <> 0 AS eligible FROM events),
  s AS (SELECT *, eligible AND sum(eligible::INT) OVER (PARTITION BY file, slide ORDER BY image_index) <= 3 AS passed FROM i)
SELECT image_index, passed AND sum(passed::INT) OVER (PARTITION BY file ORDER BY slide, image_index) <= 7 AS granted FROM s""")
def vision_budget(spark, sf_dir):
    images = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), (F.col("event_id") % 4).alias("slide"), F.col("event_id").alias("image_index"), (F.col("event_id") % 3 != 0).alias("eligible"))
    return chunking.vision_budget(images, 7, 3).select("image_index", "granted")


#: Questions of three intents: each 50th document after words of a task, of a place or of neither.
_PREFIXES = ["huong dan cac buoc ", "vi tri menu ", ""]


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks, asked = _searched(spark, sf_dir)
    prefix = F.element_at(F.array(*map(F.lit, _PREFIXES)), ((F.col("query_id") / 50) % 3 + 1).cast("int"))
    return chunks, asked.withColumn("text", F.concat(prefix, "text"))


_ROUTES_SQL = f"""routes AS (SELECT query_id, CASE intent WHEN 'TaskInstruction' THEN 'instruction_text' WHEN 'UiLocation' THEN 'image_ui_description' END AS kind, top_k FROM (
  SELECT query_id, {_intent_sql('text')} AS intent, least(CASE WHEN {_lookup_sql('text')} THEN 100 WHEN {_kind_sql(fold_sql('text'))} IS NOT NULL OR {_intent_sql('text')} = 'TaskInstruction' THEN 20 ELSE 3 END, 50) AS top_k FROM queries))"""
_IN_KIND = "(r.kind IS NULL OR c.content_kind = r.kind)"


@query(f"""WITH {CORPUS_SQL}, {_QUERIES_SQL.replace("c.document AS text", f"{_PREFIXES}[c.row_seq // 50 % 3 + 1] || c.document AS text")}, {_ROUTES_SQL}, {_VECTOR_SQL}, {_BM25_SQL}, {_EXACT_SQL},
  v AS (SELECT * FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS vr FROM near c JOIN routes r USING (query_id) WHERE {_IN_KIND}) WHERE vr <= 200),
  k AS (SELECT * FROM (SELECT query_id, s.id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.id) AS kr FROM scored s JOIN corpus c ON c.id = s.id JOIN routes r USING (query_id) WHERE {_IN_KIND}) WHERE kr <= 200),
  e AS (SELECT query_id, x.id FROM exacts x JOIN corpus c ON c.id = x.id JOIN routes r USING (query_id) WHERE {_IN_KIND}),
  cand AS (SELECT query_id, id FROM v UNION SELECT query_id, id FROM e UNION SELECT query_id, id FROM k),
  fused AS (
    SELECT c.query_id, c.id, coalesce(distance, 1.7976931348623157e308) AS distance,
      round(1.0::DOUBLE / (60 + coalesce(vr, 9999)) + 1.0::DOUBLE / (60 + coalesce(kr, 9999)) + (CASE WHEN e.id IS NULL THEN 0 ELSE 10000.0::DOUBLE END), 9) AS score
    FROM cand c LEFT JOIN v ON v.query_id = c.query_id AND v.id = c.id LEFT JOIN k ON k.query_id = c.query_id AND k.id = c.id LEFT JOIN e ON e.query_id = c.query_id AND e.id = c.id)
SELECT query_id, id, distance, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) JOIN routes USING (query_id) WHERE rank <= top_k""")
def routed_search(spark, sf_dir):
    chunks, asked = _asked(spark, sf_dir)
    asked = answers.kept(answers.classified(asked))
    return answers.routed_search(chunks, asked, fulltext.built(corpus(spark, sf_dir), asked))


# --- beyond SQL ------------------------------------------------------------------------------------------------------


@query()
def context_text(spark, sf_dir):
    chunks, asked = _asked(spark, sf_dir)
    asked = answers.kept(asked)
    return answers.answer_contexts(chunks, asked, index=fulltext.built(corpus(spark, sf_dir), asked))


@query()
def ask_messages(spark, sf_dir):
    """Every message of every conversation, some of them questions about customers or what was named before, over documents and customers' records."""
    chunks = corpus(spark, sf_dir).drop("embedding")
    rows = records(spark, sf_dir).select(F.concat(F.lit("record_"), "record_id").alias("id"), (F.col("record_id") + 1000000000).alias("row_seq"), F.col("text").alias("document"), F.lit("records.csv").alias("source"), F.col("record_id").cast("string").alias("row"))
    all_ = embed(chunks.unionByName(rows, allowMissingColumns=True), "document")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.timestamp_seconds(F.col("turn") * 60).alias("ts"), (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    said = questions(spark, sf_dir).withColumnRenamed("text", "said").join(c, "query_id")
    text_ = F.when(F.col("turn") % 7 == 3, "của ai").when(F.col("turn") % 7 == 5, "Xin chào").otherwise(F.col("said"))
    told = answers.ask(all_, said.withColumn("text", text_))
    return told.select("query_id", "effective", "outcome", "reply", F.md5("context").alias("context_digest"), "max_tokens", F.size("citations").alias("n_citations"))


@query()
def slide_text_clean(spark, sf_dir):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cleaned(t):
        return t.map(lambda x: None if x is None else clean_slide_text(x))

    return _texts(spark, sf_dir).select("key", cleaned(F.regexp_replace("text", r", ", "\t")).alias("cleaned"))


@query()
def hashed_embedding(spark, sf_dir):
    return embed(_texts(spark, sf_dir), "text").select("key", "embedding")


@query(f"""WITH {CORPUS_SQL} SELECT content_kind, action_kind, count(*) AS n FROM corpus GROUP BY ALL""")
def metadata_values(spark, sf_dir):
    m = F.col("metadata")
    return corpus(spark, sf_dir).groupBy(metadata_value(m, "content_kind").alias("content_kind"), metadata_value(m, "action_kind").alias("action_kind")).agg(F.count("*").alias("n"))
