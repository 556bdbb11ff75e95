"""Queries of candidate ranking, index upkeep, metadata statements and plain SQL operations, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolith.functions import text as tx
from neurolith.functions.distributed import as_of
from neurolith.operators import index as ix
from neurolith.operators import papers as pp
from neurolith.operators import tables as tb
from neurolith.plans.signal_queries import snap, snap_sql
from neurolith.plans.text_queries import KEY, _terms
from neurolith.session import table

ORDER = ["part", "pos", "candidate_id"]


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the search of a query: those given directly, then the model's, then what the searches found."""
    c = table(spark, d, "candidates").filter("query_id is not null")
    given, model = F.coalesce("source", F.lit("")) == "direct_url", F.coalesce("source", F.lit("")) == "model_candidate"
    return pp.gathered(c.filter(given), c.filter(model), c.filter(~given & ~model))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, query_text, search_query): of each query the material fetched first."""
    m = table(spark, d, "paper_materials").filter("query_text is not null").select("material_id", "candidate_id", "query_text", "search_query", "fetched_at")
    x = m.join(table(spark, d, "candidates").select("candidate_id", "query_id"), "candidate_id").filter("query_id is not null")
    return tb.latest(x, ["query_id"], F.asc_nulls_last("fetched_at"), F.col("material_id")).select("query_id", "query_text", "search_query")


def paper_sources_stacked(spark, d):
    return _parts(spark, d).select("candidate_id", "query_id", "part", "pos")


def paper_candidates(spark, d):
    """Of each query the first eight candidates without repeats, those with a PDF, an abstract or given directly first."""
    return pp.deduplicated(_parts(spark, d), ["query_id"], ORDER).select("query_id", "candidate_id", "key", "rank")


def paper_ranking(spark, d):
    x = pp.ranked(_parts(spark, d), _asked(spark, d), "query_id", ORDER)
    return x.select("query_id", "candidate_id", "rn", snap(F.col("score")).alias("score"))


def search_expansion(spark, d):
    """Queries of a search: the search text, and title and DOI of the candidate that a material was made from."""
    m = table(spark, d, "paper_materials").filter("query_text is not null").select("material_id", "candidate_id", "query_text", "search_query")
    x = m.join(table(spark, d, "candidates").select("candidate_id", "title", "doi"), "candidate_id", "left")
    q = pp.expanded_queries(F.col("query_text"), F.array("search_query"), F.array("title"), F.array("doi"))
    return x.select("material_id", F.posexplode(q).alias("pos", "query"))


def paper_folders(spark, d):
    """Where the paper of each candidate is kept already: folders of the materials by identity key or title."""
    c = table(spark, d, "candidates")
    made = table(spark, d, "paper_materials").select("candidate_id", F.col("workspace").alias("folder")).filter("folder is not null")
    stored = pp.with_identity(made.join(c, "candidate_id")).select("key", "title", "folder")
    return pp.known_folders(c, stored)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: (source, path, updated_at, size_chars, text)."""
    x = table(spark, d, "documents").filter("doc_id is not null")
    return x.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), F.concat(F.lit("/kb/"), F.col("doc_id").cast("string")).alias("path"), F.col("added_at").alias("updated_at"), F.char_length("text").cast("bigint").alias("size_chars"), "text")


def _old_index(spark: SparkSession, d: str) -> DataFrame:
    """An index made before the last documents were added: null languages are switched off, first paragraphs only."""
    x = table(spark, d, "documents").filter("doc_id is not null and text is not null and source is not null")
    source = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return x.select(F.concat(source, F.lit("#0")).alias("chunk_id"), source.alias("source"), F.lit(0).alias("ord"), F.lit("as it was").alias("content"), F.col("lang").isNotNull().alias("enabled"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """Entries of that index: sizes as the documents state them, and a file that is gone."""
    x = table(spark, d, "documents").filter("doc_id is not null and text is not null and source is not null")
    own = x.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), F.concat(F.lit("/kb/"), F.col("doc_id").cast("string")).alias("path"), F.col("added_at").alias("updated_at"), F.when(F.col("lang").isNull(), F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size_chars"))
    gone = table(spark, d, "region").limit(1).select(F.lit("documents/gone.md").alias("source"), F.lit("/kb/gone").alias("path"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(1).cast("bigint").alias("size_chars"))
    return own.unionByName(gone)


def index_refresh(spark, d):
    """All readable documents by paragraphs, with the flags of the old index by chunk."""
    return ix.refresh(_files(spark, d), _old_index(spark, d), ix.by_paragraphs, None)


def index_states(spark, d):
    return ix.states(_files(spark, d), _manifest(spark, d))


def index_update(spark, d):
    """The old index after what was stale, new or gone since is mended."""
    files = _files(spark, d)
    return ix.update(_old_index(spark, d), files, ix.states(files, _manifest(spark, d)), ix.by_paragraphs, None)


def index_embedded(spark, d):
    """Length and number of buckets of the vectors that are stored with the chunks."""
    x = ix.refresh(_files(spark, d), None, ix.by_sentences, 4096)
    return x.select("chunk_id", F.size("buckets").alias("buckets"), snap(F.sqrt(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w))).alias("norm"))


def index_load(spark, d):
    """Chunks of the table that have content, after a check that no source is stale."""
    c = table(spark, d, "chunks").select("chunk_id", "source", "content")
    state = c.select("source", F.lit("current").alias("state")).distinct()
    return ix.loaded(c, state).select("chunk_id", "source").distinct()


def kb_sources(spark, d):
    return ix.listed(table(spark, d, "kb_documents"), 50)


def kb_source_text(spark, d):
    """Beginning of the first chunk of the document that a file name leads to."""
    k = ix.found(table(spark, d, "kb_documents").select("document_id", "source"), "000010.docx")
    c = tb.latest(table(spark, d, "chunks").filter("content is not null").select("document_id", "ord", "content"), ["document_id"], F.col("ord"), F.col("content"))
    return k.join(c, "document_id", "left").select("document_id", "source", ix.excerpt(F.col("content"), 200).alias("text"))


def guardrail_notes(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.guardrail(F.col("text")).alias("note"))


def stream_pieces(spark, d):
    m = table(spark, d, "paper_materials").filter("query_text is not null")
    return m.select("material_id", F.posexplode(tx.stream_pieces(F.col("query_text"))).alias("pos", "piece"))


def tidy_chunks(spark, d):
    c = table(spark, d, "chunks").filter("content is not null").select("chunk_id", "content").distinct()
    return c.select("chunk_id", tx.tidy(F.col("content")).alias("content"))


def preprint_pdfs(spark, d):
    """Links to PDFs of candidates' links, as the abstract pages of a preprint server would have them."""
    url = F.regexp_replace("url", "^https://[^/]*/item/", "https://arxiv.org/abs/")
    return table(spark, d, "candidates").filter("url is not null").select("candidate_id", tx.preprint_pdf(url).alias("pdf"))


def embedded_json(spark, d):
    e = table(spark, d, "events")
    said = F.concat(F.lit("Here it is:\n"), F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.col("props")), F.lit("\nDone."))
    return e.select("event_id", tx.embedded_json(said).alias("json"))


def context_blocks(spark, d):
    from neurolith.operators import retrieval as rt

    c = tb.latest(table(spark, d, "chunks").filter("ord < 4 and content is not null"), ["document_id", "ord"], F.col("indexed_at"), F.col("content"))
    hits = c.select(F.col("document_id").alias("query_id"), (F.col("ord") + 1).alias("rn"), F.coalesce("title", F.lit("")).alias("title"), "content")
    return rt.context_block(hits)


def metadata_default_project(spark, d):
    """A default project where there is none."""
    none = spark.createDataFrame([], "id string, name string")
    row = table(spark, d, "region").limit(1).select(F.lit("project_default").alias("id"), F.lit("default").alias("name"))
    return tb.with_default(tb.with_default(none, row), row.withColumn("id", F.lit("never")))


def _experiments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "experiments").select("experiment_id", "dataset_id", "status", F.concat(F.lit("made at seed "), F.col("seed").cast("string")).alias("result"))


def experiments_reset(spark, d):
    """Failed experiments back to the start, without results."""
    return tb.updated(_experiments(spark, d), F.col("status") == "failed", {"status": F.lit("created"), "result": F.lit(None).cast("string")})


def experiments_finished(spark, d):
    """Running experiments take over the state that their jobs ended in: failed ones without a dataset."""
    done = table(spark, d, "experiments").filter("status = 'running'").select("experiment_id", F.when(F.col("dataset_id").isNull(), "failed").otherwise("succeeded").alias("status"))
    return tb.merged(_experiments(spark, d), done, "experiment_id")


def datasets_inserted(spark, d):
    """A row for each dataset of the recordings that no experiment knows yet, below those known."""
    known = table(spark, d, "experiments").filter("dataset_id is not null").select(F.col("dataset_id").alias("id")).distinct().withColumn("suffix", F.lit("old"))
    r = table(spark, d, "recordings").filter("dataset_id is not null").groupBy(F.col("dataset_id").alias("id")).agg(F.min("source_format").alias("suffix"), F.countDistinct("recording_id").alias("files"))
    return tb.inserted(known.withColumn("files", F.lit(None).cast("bigint")), tb.deleted(r, known, "id"))


def jobs_queued(spark, d):
    """Experiments and a new, queued job for each that was just created."""
    x = _experiments(spark, d)
    jobs = x.select(F.concat(F.lit("job_"), "experiment_id").alias("job_id"), "experiment_id", "status", F.lit(1.0).alias("progress"))
    new = x.filter("status = 'created'").select(F.concat(F.lit("run_"), "experiment_id").alias("job_id"), "experiment_id", F.lit("queued").alias("status"), F.lit(0.0).alias("progress"))
    return tb.inserted(jobs, new)


def rows_affected(spark, d):
    """How many recordings a delete of each dataset of the experiments would take with it."""
    return tb.affected(table(spark, d, "recordings"), table(spark, d, "experiments").filter("dataset_id is not null"), "dataset_id")


def jobs_deleted(spark, d):
    """Events without those whose payload names a value that failed."""
    e = table(spark, d, "events")
    gone = e.filter("event_type = 'error'").select(F.get_json_object("props", "$.k").alias("k")).filter("k in ('1', '2', '3')")
    return tb.deleted(e.withColumn("k", F.get_json_object("props", "$.k")), gone, "k").select("event_id", "k")


def dashboard_recent(spark, d):
    """The five newest of each kind."""
    kinds = {"recordings": ("recording_id", "uploaded_at"), "experiments": ("experiment_id", "created_at"), "kb_documents": ("document_id", "updated_at")}
    parts = [tb.newest(table(spark, d, t), 5, at, i).select(F.lit(t).alias("kind"), F.col(i).alias("id"), F.col(at).alias("at")) for t, (i, at) in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def buyers_with_errors(spark, d):
    """Users with purchases and errors, and with purchases but no sign-up: INTERSECT and EXCEPT."""
    e = table(spark, d, "events")
    of = lambda k: e.filter(F.col("event_type") == k).select("user_id")
    both = of("purchase").intersect(of("error")).withColumn("kind", F.lit("both"))
    return both.unionByName(of("purchase").exceptAll(of("signup")).distinct().withColumn("kind", F.lit("bought more"))).unionByName(of("purchase").subtract(of("signup")).withColumn("kind", F.lit("no sign-up")))


def last_view(spark, d):
    """As-of join: for each purchase the value of the latest view of that user at or before it."""
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    views = e.filter("event_type = 'view'").select("user_id", "us", F.col("value").alias("seen"))
    x = as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "us"), views, "user_id", "us", "seen", width=3_600_000_000)
    return x.select("event_id", "user_id", snap(F.col("seen")).alias("seen"))


def decimal_revenue(spark, d):
    """Exact sums of decimals."""
    m = lambda c: F.col(c).cast("decimal(12,2)")
    x = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    net = m("l_extendedprice") * (F.lit(1).cast("decimal(12,2)") - m("l_discount"))
    return x.agg(F.sum(m("l_extendedprice")).cast("string").alias("gross"), F.sum(net.cast("decimal(18,4)")).cast("string").alias("net"), F.count(F.lit(1)).alias("n"))


def ship_delays(spark, d):
    """Dates and intervals: days from order to shipping by quarter, and how many were shipped within 30 days."""
    o, x = table(spark, d, "orders"), table(spark, d, "lineitem")
    j = x.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff("l_shipdate", "o_orderdate")
    soon = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return j.groupBy(F.date_format(F.date_trunc("quarter", "o_orderdate"), "yyyy-MM-dd").alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.sum(days.cast("bigint")).alias("days"), F.sum(soon.cast("bigint")).alias("soon"))


BLANK = tx.BLANK
PARTS = "p AS (SELECT *, CASE WHEN coalesce(source, '') = 'direct_url' THEN 0 WHEN coalesce(source, '') = 'model_candidate' THEN 1 ELSE 2 END AS part FROM candidates WHERE query_id IS NOT NULL)"
DEDUPED = f"""{PARTS}, k AS (SELECT *, {KEY} AS key FROM p), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY part NULLS FIRST, pos NULLS FIRST, candidate_id) AS rn1 FROM k) WHERE rn1 = 1),
        c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pdf_url IS NULL, coalesce(abstract, '') = '', coalesce(source, '') <> 'direct_url', part NULLS FIRST, pos NULLS FIRST, candidate_id) - 1 AS rank FROM f) WHERE rank < 8)"""
FILE = "'documents/' || doc_id || '.md'"
PARAGRAPHS = rf"""f AS (SELECT {FILE} AS source, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND trim(regexp_replace(text, '{BLANK}+', ' ', 'g')) <> ''),
        g AS (SELECT source, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: regexp_replace(x, '^[ \t\n]+|[ \t\n]+$', '', 'g')), lambda x: x <> '') AS l FROM f),
        n AS (SELECT source, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS ord, unnest(l) AS content FROM g)"""
OLD = f"o AS (SELECT {FILE} AS source, 0 AS ord, 'as it was' AS content, lang IS NOT NULL AS enabled FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL)"
STATES = f"""s AS (SELECT {FILE} AS source, CASE WHEN text IS NULL OR source IS NULL THEN 'unindexed' WHEN length(text) IS NOT DISTINCT FROM CASE WHEN lang IS NULL THEN n_chars + 1 ELSE n_chars END THEN 'current' ELSE 'stale' END AS state FROM documents WHERE doc_id IS NOT NULL
        UNION ALL SELECT 'documents/gone.md', 'missing')"""
TITLE = r"trim(regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{N}_]+', ' ', 'g'))"


def _guardrail_sql() -> str:
    from neurolith.plans.text_queries import _route_sql

    return f"WITH r AS ({_route_sql()}) SELECT doc_id, CASE WHEN route = 'chat' THEN '{tx.PLAIN_CHAT}' WHEN regexp_matches(lower(text), '{'|'.join(tx.DOMAIN)}') THEN '{tx.IN_DOMAIN}' WHEN text IS NOT NULL THEN '{tx.OUTSIDE}' END AS note FROM documents JOIN r USING (doc_id)"


SQL = {
    "paper_sources_stacked": f"WITH {PARTS} SELECT candidate_id, query_id, part, pos FROM p",
    "paper_candidates": f"WITH {DEDUPED} SELECT query_id, candidate_id, key, CAST(rank AS INTEGER) AS rank FROM c",
    "paper_ranking": f"""WITH {DEDUPED}, a AS (SELECT query_id, query_text FROM (SELECT c.query_id, m.query_text, row_number() OVER (PARTITION BY c.query_id ORDER BY m.fetched_at NULLS LAST, m.material_id) AS rn FROM paper_materials m JOIN candidates c USING (candidate_id) WHERE m.query_text IS NOT NULL AND c.query_id IS NOT NULL) WHERE rn = 1),
        t AS (SELECT c.*, {_terms('query_text')} AS q, {_terms("concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''), array_to_string(authors, ' '), coalesce(doi, ''))")} AS al, {_terms("coalesce(title, '')")} AS ti FROM c JOIN a USING (query_id)),
        s AS (SELECT *, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, al)) / greatest(len(q), 1) + 0.35::DOUBLE * len(list_intersect(q, ti)) / greatest(len(q), 1) + CASE WHEN pdf_url IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN coalesce(doi, '') <> '' THEN 0.03::DOUBLE ELSE 0 END END AS score FROM t),
        w AS (SELECT * FROM s WHERE score >= 0.18::DOUBLE OR source IN ('direct_url', 'model_candidate'))
        SELECT query_id, candidate_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pdf_url IS NULL, coalesce(abstract, '') = '', rank) AS INTEGER) AS rn, {snap_sql('score')} AS score FROM w""",
    "search_expansion": f"""WITH x AS (SELECT m.material_id, m.query_text, [m.search_query, c.title, c.doi] AS l FROM paper_materials m LEFT JOIN candidates c USING (candidate_id) WHERE m.query_text IS NOT NULL),
        e AS (SELECT material_id, generate_subscripts(l, 1) AS i, trim(regexp_replace(unnest(l), '{BLANK}+', ' ', 'g')) AS q FROM x),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY material_id, lower(q) ORDER BY i) AS rn FROM e WHERE q IS NOT NULL AND q <> '') WHERE rn = 1),
        o AS (SELECT material_id, q, row_number() OVER (PARTITION BY material_id ORDER BY i) - 1 AS pos FROM f UNION ALL SELECT material_id, trim(query_text), 0 FROM x WHERE material_id NOT IN (SELECT material_id FROM f))
        SELECT material_id, CAST(pos AS INTEGER) AS pos, q AS query FROM o WHERE pos < 8""",
    "paper_folders": f"""WITH k AS (SELECT candidate_id, {KEY} AS key, {TITLE} AS t FROM candidates), s AS (SELECT k.key, k.t, m.workspace AS folder FROM paper_materials m JOIN k USING (candidate_id) WHERE m.workspace IS NOT NULL),
        a AS (SELECT key, min(folder) AS by_key FROM s GROUP BY 1), b AS (SELECT t, min(folder) AS by_title FROM s WHERE t <> '' GROUP BY 1)
        SELECT candidate_id, coalesce(by_key, by_title) AS folder, CASE WHEN by_key IS NOT NULL THEN 'key' ELSE 'title' END AS "by" FROM k LEFT JOIN a USING (key) LEFT JOIN b USING (t) WHERE coalesce(by_key, by_title) IS NOT NULL""",
    "index_refresh": f"WITH {PARAGRAPHS}, {OLD} SELECT n.source || '#' || n.ord AS chunk_id, n.source, n.ord, n.content, coalesce(o.enabled, true) AS enabled FROM n LEFT JOIN o ON o.source = n.source AND o.ord = n.ord",
    "index_states": f"WITH {STATES} SELECT source, state FROM s",
    "index_update": f"""WITH {PARAGRAPHS}, {OLD}, {STATES} SELECT source || '#0' AS chunk_id, source, ord, content, enabled FROM o WHERE source IN (SELECT source FROM s WHERE state = 'current')
        UNION ALL SELECT n.source || '#' || n.ord, n.source, n.ord, n.content, coalesce(o.enabled, true) FROM n LEFT JOIN o ON o.source = n.source AND o.ord = n.ord WHERE n.source IN (SELECT source FROM s WHERE state IN ('stale', 'unindexed'))""",
    "index_load": "SELECT DISTINCT chunk_id, source FROM chunks WHERE content <> ''",
    "kb_sources": "SELECT DISTINCT source FROM kb_documents ORDER BY source LIMIT 50",
    "kb_source_text": """WITH k AS (SELECT document_id, source FROM kb_documents WHERE source LIKE '%000010.docx' ORDER BY source <> '000010.docx', source LIMIT 1),
        c AS (SELECT document_id, content FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ord, content) AS rn FROM chunks WHERE content IS NOT NULL) WHERE rn = 1) SELECT k.document_id, source, substr(content, 1, 200) AS text FROM k LEFT JOIN c USING (document_id)""",
    "guardrail_notes": _guardrail_sql(),
    "stream_pieces": r"""WITH l AS (SELECT material_id, regexp_extract_all(query_text, '[^。！？\n]{0,27}[。！？\n]|[^。！？\n]{28}|[^。！？\n]+') AS l FROM paper_materials WHERE query_text IS NOT NULL)
        SELECT material_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS piece FROM l""",
    "tidy_chunks": r"""WITH c AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE content IS NOT NULL), a AS (SELECT chunk_id, regexp_replace(regexp_replace(replace(content, chr(0), ''), '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g') AS t FROM c)
        SELECT chunk_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^ | $', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS content FROM a""",
    "preprint_pdfs": "SELECT candidate_id, CASE WHEN u LIKE '%arxiv.org/abs/%' THEN replace(u, '/abs/', '/pdf/') || CASE WHEN u LIKE '%.pdf' THEN '' ELSE '.pdf' END END AS pdf FROM (SELECT candidate_id, regexp_replace(url, '^https://[^/]*/item/', 'https://arxiv.org/abs/') AS u FROM candidates WHERE url IS NOT NULL)",
    "embedded_json": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS json FROM events",
    "context_blocks": """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, ord ORDER BY indexed_at, content) AS rn FROM chunks WHERE ord < 4 AND content IS NOT NULL) WHERE rn = 1)
        SELECT document_id AS query_id, string_agg('[' || (ord + 1) || '] ' || coalesce(title, '') || chr(10) || content, chr(10) || chr(10) ORDER BY ord) AS context FROM c GROUP BY 1""",
    "metadata_default_project": "SELECT 'project_default' AS id, 'default' AS name",
    "experiments_reset": "SELECT experiment_id, dataset_id, CASE WHEN status = 'failed' THEN 'created' ELSE status END AS status, CASE WHEN status = 'failed' THEN NULL ELSE 'made at seed ' || seed END AS result FROM experiments",
    "experiments_finished": "SELECT experiment_id, dataset_id, CASE WHEN status <> 'running' OR status IS NULL THEN status WHEN dataset_id IS NULL THEN 'failed' ELSE 'succeeded' END AS status, 'made at seed ' || seed AS result FROM experiments",
    "datasets_inserted": """SELECT DISTINCT dataset_id AS id, 'old' AS suffix, CAST(NULL AS BIGINT) AS files FROM experiments WHERE dataset_id IS NOT NULL
        UNION ALL SELECT dataset_id, min(source_format), count(DISTINCT recording_id) FROM recordings WHERE dataset_id IS NOT NULL AND dataset_id NOT IN (SELECT dataset_id FROM experiments WHERE dataset_id IS NOT NULL) GROUP BY 1""",
    "jobs_queued": "SELECT 'job_' || experiment_id AS job_id, experiment_id, status, 1.0::DOUBLE AS progress FROM experiments UNION ALL SELECT 'run_' || experiment_id, experiment_id, 'queued', 0.0 FROM experiments WHERE status = 'created'",
    "rows_affected": "SELECT x.dataset_id, count(r.recording_id) AS n FROM (SELECT DISTINCT dataset_id FROM experiments WHERE dataset_id IS NOT NULL) x LEFT JOIN recordings r USING (dataset_id) GROUP BY 1",
    "jobs_deleted": "WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, k FROM e WHERE k IS NULL OR k NOT IN (SELECT k FROM e WHERE event_type = 'error' AND k IN ('1', '2', '3'))",
    "dashboard_recent": """SELECT * FROM (SELECT 'recordings' AS kind, recording_id AS id, uploaded_at AS "at" FROM recordings ORDER BY uploaded_at DESC NULLS LAST, recording_id DESC LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'experiments', experiment_id, created_at FROM experiments ORDER BY created_at DESC NULLS LAST, experiment_id DESC LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'kb_documents', document_id, updated_at FROM kb_documents ORDER BY updated_at DESC NULLS LAST, document_id DESC LIMIT 5)""",
    "buyers_with_errors": """SELECT user_id, 'both' AS kind FROM (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')
        UNION ALL SELECT DISTINCT user_id, 'bought more' FROM (SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'signup')
        UNION ALL SELECT user_id, 'no sign-up' FROM (SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup')""",
    "last_view": f"""WITH v AS (SELECT user_id, ts, max(value) AS seen FROM events WHERE event_type = 'view' AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)
        SELECT e.event_id, e.user_id, {snap_sql('v.seen')} AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""",
    "decimal_revenue": """SELECT l_returnflag, l_linestatus, sum(CAST(l_extendedprice AS DECIMAL(12,2)))::VARCHAR AS gross, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))))::VARCHAR AS net, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "ship_delays": """SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter, count(*) AS n, CAST(sum(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS BIGINT) AS days,
        count(*) FILTER (l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY) AS soon FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        paper_sources_stacked, paper_candidates, paper_ranking, search_expansion, paper_folders, index_refresh, index_states, index_update, index_embedded,
        index_load, kb_sources, kb_source_text, guardrail_notes, stream_pieces, tidy_chunks, preprint_pdfs, embedded_json, context_blocks,
        metadata_default_project, experiments_reset, experiments_finished, datasets_inserted, jobs_queued, rows_affected, jobs_deleted, dashboard_recent,
        buyers_with_errors, last_view, decimal_revenue, ship_delays,
    )
}
