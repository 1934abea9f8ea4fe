"""The derived views of :mod:`quarry.plans.views` written as DuckDB SQL (CTE bodies).

Used only to build the oracle SQL strings of the query catalogue.
"""

CORPUS_CTES = {
    "tokens": "SELECT l_orderkey AS textID, l_partkey AS wordID, CAST(l_linenumber AS BIGINT) AS occID FROM lineitem",
    "words": "SELECT CASE WHEN p_size > 5 THEN p_partkey ELSE -p_partkey END AS wordID, concat(p_brand, ' ', p_name) AS word, p_name AS lemma, p_type AS pos "
             "FROM part",
    "texts": "SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderkey ELSE -o_orderkey END AS textID, CAST(year(o_orderdate) AS INT) AS year, "
             "CAST(year(o_orderdate) - year(o_orderdate) % 10 AS INT) AS decade, o_orderpriority AS genre "
             "FROM orders",
    "joined": "SELECT t.textID, t.wordID, t.occID, w.word, w.lemma, w.pos, x.year, x.decade, x.genre "
              "FROM tokens t LEFT JOIN words w ON t.wordID = w.wordID LEFT JOIN texts x ON t.textID = x.textID",
}

AUG = ("SELECT doc_id, lang, source, CASE doc_id % 4 "
       "WHEN 0 THEN concat(text, ' Dr Ann Lee said it may work. Mr Bob Ray would not!') "
       "WHEN 1 THEN concat('Professor Ida Moss must agree. ', text) "
       "WHEN 2 THEN concat(text, ' We asked Mr. Cole and Ms Jo Park.') "
       "ELSE text END AS text FROM documents")

# the marker of record rn, as quarry.plans.views.marker writes it
MARKER = ("concat('Document', CASE WHEN rn % 5 = 1 THEN chr(160) ELSE ' ' END, rn, "
          "CASE WHEN rn % 5 = 2 THEN chr(10) ELSE ' ' END, 'of ', cnt)")


def bundle(src: str, n: int | None = None) -> str:
    """(source, doc_id, text) rows of ``src`` -> one export per (source, doc_id div n)."""
    from quarry.plans.views import DUMP_SIZE
    n = n or DUMP_SIZE
    return ("SELECT source, chunk, string_agg(concat(" + MARKER + ", chr(10), chr(10), text, chr(10)), "
            f"'' ORDER BY rn) AS blob FROM (SELECT source, text, doc_id // {n} AS chunk, "
            f"row_number() OVER (PARTITION BY source, doc_id // {n} ORDER BY doc_id) AS rn, "
            f"count(*) OVER (PARTITION BY source, doc_id // {n}) AS cnt FROM {src}) d GROUP BY source, chunk")


DUMP = bundle("documents")

# documents numbered the way the dump numbers them
def dump_docs(n: int | None = None) -> str:
    """Documents numbered the way an export of ``n`` doc_ids numbers them."""
    from quarry.plans.views import DUMP_SIZE
    n = n or DUMP_SIZE
    return (f"SELECT source, doc_id // {n} AS chunk, doc_id, text, "
            f"row_number() OVER (PARTITION BY source, doc_id // {n} ORDER BY doc_id) AS rn, "
            f"count(*) OVER (PARTITION BY source, doc_id // {n}) AS cnt FROM documents")


DUMP_DOCS = dump_docs()

REC_BODY = ("concat('Piece ', doc_id, ': [Op-Ed]: [Op-Ed]', chr(10), chr(10), "
       "CASE WHEN doc_id % 5 <> 0 THEN concat('Author: ', source, chr(10), chr(10)) ELSE '' END, "
       "'https://example.org/d/', doc_id, chr(10), chr(10), 'Abstract: None available.', chr(10), chr(10), "
       "'Full text: ', text, chr(10), chr(10), "
       "CASE WHEN doc_id % 3 = 0 THEN concat('Subject: ', lang, chr(10), chr(10)) ELSE '' END, "
       "'URL: https://example.org/u/', doc_id, chr(10), chr(10), "
       "'Publication date: Jan 2, 2022', chr(10), chr(10), 'Section: ', lang)")
REC = f"SELECT doc_id, {REC_BODY} AS body FROM documents"
REC_DUMP = bundle(f"(SELECT source, doc_id, {REC_BODY} AS text FROM documents)")

MEAS_T = "SELECT doc_id AS id, lang, n_chars FROM documents"
MEAS_M = ("SELECT concat('article_', lpad(CAST(doc_id AS VARCHAR), "
          "CAST(greatest(3, length(CAST(doc_id AS VARCHAR))) AS INT), '0'), '.txt') AS filename, quality, toxic "
          "FROM labels")

FEED = ("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS source, "
        "CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS author, "
        "concat('Mr Bob Ray on ', lang) AS title, "
        "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'A talk with Ms Jo Park' END AS description, "
        "text AS content, concat('https://example.org/d/', doc_id) AS url, "
        "strftime(make_timestamp(CAST((1704067200 + doc_id * 60) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') "
        "AS publishedAt FROM aug")


def with_ctes(body: str, **ctes: str) -> str:
    """``WITH a AS (...), b AS (...) body``."""
    if not ctes:
        return body
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " " + body


def corpus(body: str, extra: dict | None = None) -> str:
    ctes = dict(CORPUS_CTES)
    ctes.update(extra or {})
    return with_ctes(body, **ctes)


def aug_pages() -> str:
    from quarry.plans.views import PAGE_INSERT
    ins = PAGE_INSERT.replace("'", "''")
    return (f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(html, '</article>', '{ins}') "
            "ELSE html END AS html FROM pages")
