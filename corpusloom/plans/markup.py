"""HTML, diff and rule queries on pages and documents, and validation gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import diff as D
from corpusloom.operators import html as H
from corpusloom.operators.references import candidates
from corpusloom.plans.registry import Registry
from corpusloom.sources import bridge
from corpusloom.sources.bridge import CITATIONS_SQL, OUTCOMES_SQL, SECTIONS_SQL, table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS link FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, through the box parser."""
    return H.boxes(table(spark, sf_dir, "pages")).select("page_id", F.explode("links").alias("link"))


@query()
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with cleaned text and the number of their format spans; rows only."""
    b = H.boxes(table(spark, sf_dir, "pages"))
    return b.select("page_id", "pos", "tag", "start_offset", H.clean_lines(F.col("text")).alias("text"), F.size("spans").alias("n_spans"))


@query()
def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies under each heading of a page; rows only."""
    b = H.boxes(table(spark, sf_dir, "pages"))
    return H.bodies(b, "page_id", F.col("tag").rlike("^h[1-6]$"))


@query("SELECT doc_id, text AS old_text, regexp_replace(text, 'the ', 'a ', 'g') AS new_text FROM documents")
def diff_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word diffs of every document against an edited copy, put together to both texts again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace("text", "the ", "a ").alias("edited"))
    chunks = D.diff_chunks(d, "doc_id", "text", "edited")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "op", "text")))
    side = lambda skip: F.array_join(F.transform(F.filter("all", lambda x: x["op"] != skip), lambda x: x["text"]), "")
    whole = chunks.groupBy("doc_id").agg(ordered.alias("all")).select("doc_id", side("insert").alias("old_text"), side("delete").alias("new_text"))
    return d.select("doc_id").join(whole, "doc_id", "left").select("doc_id", F.coalesce("old_text", F.lit("")).alias("old_text"), F.coalesce("new_text", F.lit("")).alias("new_text"))


@query()
def diff_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that an edit touches; rows only."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace("text", "the ", "a ").alias("edited"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "(?<=\n)")).alias("seg_index", "raw"))
    return D.overlay(D.diff_chunks(d, "doc_id", "text", "edited"), lines, "doc_id")


@query()
def smoothed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their wrapped lines joined again; rows only."""
    return table(spark, sf_dir, "documents").select("doc_id", D.mapped(D.smooth, F.col("text")).alias("text"))


@query("""WITH s AS (SELECT doc_id, nullif(regexp_replace(regexp_replace(lower(strip_accents(replace(split_part(text, ' ', 1), 'ß', ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(slug, '^(con|prn|aux|nul|(com|lpt)[1-9])$') THEN slug || '-x' ELSE slug END AS slug FROM s""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of first words; accents go with their marks."""
    first = F.replace(F.split_part("text", F.lit(" "), F.lit(1)), F.lit("ß"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", D.mapped(D.slug, first).alias("slug"))


@query("""WITH s AS (SELECT doc_id, source AS module_id, CAST(doc_id % 300 AS VARCHAR) AS section_id, lang AS parent_slug FROM documents), m AS (SELECT module_id, section_id FROM s GROUP BY 1, 2 HAVING count(DISTINCT parent_slug) > 1)
SELECT doc_id, CASE WHEN m.section_id IS NULL THEN s.section_id ELSE parent_slug || '.' || s.section_id END AS qualified_id FROM s LEFT JOIN m USING (module_id, section_id)""")
def qualified_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    s = d.select("doc_id", F.col("source").alias("module_id"), (F.col("doc_id") % 300).cast("string").alias("section_id"), F.col("lang").alias("parent_slug"))
    return H.qualified_ids(s).select("doc_id", "qualified_id")


@query(f"""WITH {SECTIONS_SQL}, {CITATIONS_SQL} SELECT citing_id, citation_index, cited_id FROM citations WHERE target_kind = 'internal' AND NOT EXISTS (SELECT 1 FROM sections WHERE doc_id = cited_id)""")
def gate_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal citations without a section (anti-join)."""
    s = bridge.sections(spark, sf_dir).select(F.col("doc_id").alias("cited_id"))
    return bridge.citations(spark, sf_dir).where("target_kind = 'internal'").join(s, "cited_id", "left_anti").select("citing_id", "citation_index", "cited_id")


@query(f"""WITH {SECTIONS_SQL} SELECT module_id, count(*) AS total, count(*) FILTER (regexp_matches(section_id, '^[a-z0-9]+(?:[._-][a-z0-9]+)*$')) AS n_valid, count(*) FILTER (editorial_status = 'reserved') AS n_skipped FROM sections GROUP BY 1""")
def gate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table-of-contents coverage per module: ids that are valid, sections that were skipped."""
    s = bridge.sections(spark, sf_dir)
    return s.groupBy("module_id").agg(F.count("*").alias("total"), F.count_if(F.col("section_id").rlike("^[a-z0-9]+(?:[._-][a-z0-9]+)*$")).alias("n_valid"), F.count_if(F.col("editorial_status") == "reserved").alias("n_skipped"))


@query("""WITH v AS (SELECT doc_id, doc_id % 3 AS k, CAST(n_chars % 50 AS VARCHAR) AS ref FROM documents), fam AS (SELECT CAST(n_chars % 50 AS VARCHAR) AS ref FROM documents GROUP BY 1 HAVING count(*) > 20)
SELECT CASE WHEN k = 0 THEN 'external' WHEN fam.ref IS NOT NULL THEN 'collision_unresolvable' ELSE 'no_anchor' END AS reason, count(*) AS n FROM v LEFT JOIN fam USING (ref) GROUP BY 1""")
def gate_vague_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why citations stayed vague."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 50).cast("string").alias("ref"))
    families = d.groupBy("ref").agg(F.count("*").alias("n")).where("n > 20").select("ref", F.lit(True).alias("family"))
    reason = F.when(F.col("doc_id") % 3 == 0, "external").when(F.col("family"), "collision_unresolvable").otherwise("no_anchor")
    return d.join(families, "ref", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {OUTCOMES_SQL}, b AS (SELECT file_no, count(*) FILTER (status IN ('anchored', 'added_section')) AS n_shown, sum(n_words) AS w FROM outcomes GROUP BY 1)
SELECT file_no, 'no_diff' AS violation FROM b WHERE n_shown > 0 AND w = 0 UNION ALL SELECT file_no, 'repeated_section' FROM (SELECT file_no, section_id FROM outcomes GROUP BY 1, 2 HAVING count(*) > 1)""")
def gate_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break an invariant of bills, one per violation."""
    o = bridge.outcomes(spark, sf_dir)
    shown = o.groupBy("file_no").agg(F.count_if(F.col("status").isin("anchored", "added_section")).alias("n"), F.sum("n_words").alias("w")).where("n > 0 and w = 0")
    twice = o.groupBy("file_no", "section_id").agg(F.count("*").alias("n")).where("n > 1")
    return shown.select("file_no", F.lit("no_diff").alias("violation")).union(twice.select("file_no", F.lit("repeated_section")))


@query("""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\x{00a0}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS clean FROM documents""")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), H.clean_lines(F.col("text")).alias("clean"))


@query("""WITH r AS (SELECT doc_id, lower('A' || doc_id % 90 || CASE doc_id % 2 WHEN 0 THEN '.0' ELSE '' END) AS b FROM documents), f AS (SELECT doc_id, b, CASE WHEN b LIKE '%.0' THEN left(b, length(b) - 2) ELSE b || '.0' END AS o FROM r)
SELECT doc_id, 'b' || b || ',' || b || ',g' || b || ',b' || o || ',' || o || ',g' || o AS candidates FROM f""")
def display_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor candidates of references under a module's display rules, in order."""
    ref = F.concat(F.lit("A"), (F.col("doc_id") % 90).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".0").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(candidates(ref, "b", ("g",), True), ",").alias("candidates"))
