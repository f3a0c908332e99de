"""Queries on boxes that are made from parts, by keys that vary class, anchor and heading apart from each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import boxes as B
from corpusloom.operators import redline
from corpusloom.plans.registry import Registry
from corpusloom.sources.bridge import table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql

_CLASSES = ("rbox Section", "rbox level-Section-Deleted", "rbox SubSection toc", "level-Subsection", "rbox Normal-Level", "rbox level-Article x", "Chapter-NewOrd rbox", "rbox Division---Deleted", "Section rbox", "Sections", "rbox level-SubSection-Deleted", "")
_TITLES = ("concat(p_size, '.', p_partkey % 9)", "concat('20', p_partkey % 10 + 10, ' Ordinances')", "concat('19', p_partkey % 10 + 10, ' RESOLUTIONS ')", "concat('Article ', p_size, ', Appendix ', upper(left(p_name, 1)))", "concat('Ch. ', upper(left(p_name, 2)), ' appendix b')", "concat(p_size, '(a)')", "concat('Interp. Sec. ', p_size)", "''")
_HEADINGS = ("concat('SEC. ', p_size, '.', p_partkey % 9, '. ', p_name)", "concat('[', p_name, ']')", "'New Ordinance Notice'", "concat('20', p_size + 10, ' >')", "'Zoning map'", "concat('APPENDIX ', p_size)", "concat('chapter ', p_size)", "p_name")


def _pick(key: str, forms: tuple[str, ...]) -> str:
    return f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(forms)) + " END"


_CLASS = _pick("p_partkey", tuple(f"'{c}'" for c in _CLASSES))
_TITLE = "CASE WHEN p_partkey % 5 > 0 THEN " + _pick("(p_partkey + p_size)", _TITLES) + " END"
_NAME = "CASE WHEN p_partkey % 5 > 0 THEN concat('JD_', p_partkey % 40) END"
_HEADING = _pick("(p_partkey * 3 + p_size)", _HEADINGS)
_BOX = {"module_id": "concat('m', p_size % 5)", "pos": "p_partkey", "class": _CLASS, "anchor_name": _NAME, "anchor_title": _TITLE, "heading": _HEADING}
_BOXES_SQL = "b AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _BOX.items()) + " FROM part)"
_S = "^(level-)?(Section|Subsection|SubSection)(-NewOrd|-Deleted)?$"
_NUMBERED = "regexp_matches(heading, '(?i)SEC(TION)?\\.?\\s+[0-9A-Za-z*-]')"
_HAS = lambda p: f"len(list_filter(c, lambda x: regexp_matches(x, '{p}'))) > 0"
_KINDS = f"""t AS (SELECT *, string_split_regex(class, '\\s+') AS c, trim(coalesce(anchor_title, '')) AS title FROM b),
l AS (SELECT *, CASE WHEN {_HAS("^(level-)?Article(-|$)")} THEN 'Article' WHEN {_HAS("^(level-)?Chapter(-|$)")} THEN 'Chapter' WHEN {_HAS("^(level-)?Division(-|$)")} THEN 'Division' END AS level, {_HAS(_S)} AS sectional, lower(title) AS low, string_split_regex(replace(lower(title), ',', ''), '\\s+') AS w FROM t),
k AS (SELECT *, CASE WHEN level IS NOT NULL THEN 'hierarchy_marker' WHEN NOT sectional OR (anchor_name IS NULL AND NOT {_NUMBERED}) THEN 'consumed_by_parent' WHEN regexp_matches(low, '^[0-9]{{4}} ordinances$') THEN 'ordinance_history' WHEN regexp_matches(low, '^[0-9]{{4}} resolutions$') THEN 'resolution_history'
  WHEN low LIKE '% appendix %' THEN 'appendix' WHEN low LIKE '%(a)' THEN 'consumed_by_parent' ELSE 'section' END AS kind FROM l),
kinds AS (SELECT module_id, pos, class, anchor_name, anchor_title, heading, kind, level, CASE WHEN kind LIKE '%history' THEN CAST(left(low, 4) AS INTEGER) END AS year, CASE WHEN kind = 'appendix' THEN CASE w[1] WHEN 'article' THEN 'article' ELSE 'chapter' END END AS parent_kind,
  CASE WHEN kind = 'appendix' THEN w[2] END AS parent_number, CASE WHEN kind = 'appendix' THEN w[4] END AS letter, CASE WHEN kind = 'section' THEN CASE WHEN class LIKE '%Section-Deleted%' THEN 'reserved' ELSE 'active' END END AS status, title FROM k)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(*[F.expr(e).alias(n) for n, e in _BOX.items()])


@query(f"WITH {_BOXES_SQL}, {_KINDS} SELECT pos, kind, level, year, parent_kind, parent_number, letter, status FROM kinds")
def box_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every box."""
    return B.classified(boxes(spark, sf_dir)).select("pos", "kind", "level", "year", "parent_kind", "parent_number", "letter", "status")


_DEMOTED = """f AS (SELECT *, (SELECT max(pos) FROM kinds x WHERE x.module_id = kinds.module_id AND x.kind = 'appendix' AND x.pos <= kinds.pos) AS a, (SELECT max(pos) FROM kinds x WHERE x.module_id = kinds.module_id AND x.kind = 'hierarchy_marker' AND x.pos <= kinds.pos) AS h FROM kinds),
demoted AS (SELECT * REPLACE (CASE WHEN kind = 'section' AND NOT coalesce(a > coalesce(h, -1), false) AND regexp_matches(class, '(^|\\s)(level-)?Sub[Ss]ection') AND title <> '' AND NOT regexp_matches(replace(lower(title), ' ', '-'), '^[a-z0-9]+([._-][a-z0-9]+)*$') THEN 'consumed_by_parent' ELSE kind END AS kind) FROM f)"""


@query(f"WITH {_BOXES_SQL}, {_KINDS}, {_DEMOTED} SELECT pos, kind FROM demoted")
def demoted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds after subsections without a section's title are consumed, in stretches shorter than a module."""
    return B.demoted(B.classified(boxes(spark, sf_dir)), span=64).select("pos", "kind")


@query(f"""WITH {_BOXES_SQL}, {_KINDS}, a AS (SELECT *, coalesce(nullif(lower(title), ''), lower(substr(anchor_name, 4))) AS key FROM kinds)
SELECT pos, coalesce(kind = 'section' AND key IS NOT NULL AND count(*) FILTER (kind = 'section') OVER (PARTITION BY module_id, key) > 1, false) AS shared FROM a""")
def shared_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose anchor stands at others of their module too."""
    return B.with_shared(B.classified(boxes(spark, sf_dir))).select("pos", "shared")


@query(f"""WITH {_BOXES_SQL}, {_KINDS}, m AS (SELECT module_id, count(*) AS seen, count(*) FILTER (kind IN ('consumed_by_parent', 'hierarchy_marker')) AS aside, count(*) FILTER (kind NOT IN ('consumed_by_parent', 'hierarchy_marker') AND NOT (module_id = 'm1' AND pos % 50 = 1)) AS made,
  count(*) FILTER (kind = 'section' AND NOT (module_id = 'm1' AND pos % 50 = 1)) AS sections FROM kinds GROUP BY 1)
SELECT module_id, CASE WHEN module_id = 'm2' AND sections < 1000000 THEN 'too_few_sections' ELSE 'boxes_lost' END AS reason, seen, aside + made AS accounted FROM m WHERE module_id = 'm2' OR seen <> aside + made""")
def gate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules with too few sections, or with boxes that no record accounts for."""
    rows = B.classified(boxes(spark, sf_dir))
    records = rows.where("kind not in ('consumed_by_parent', 'hierarchy_marker') and not (module_id = 'm1' and pos % 50 = 1)").select("module_id", "kind")
    least = rows.select("module_id", F.when(F.col("module_id") == "m2", 1_000_000).when(F.col("module_id") == "m3", 1).alias("min_sections")).distinct()
    return B.accounting(rows, records, least)


@query("""WITH a AS (SELECT DISTINCT p_size % 5 AS module_id, 'A' || p_partkey % 300 AS anchor FROM part WHERE p_size % 7 > 0), o AS (SELECT DISTINCT s_suppkey % 5 AS module_id, CASE s_suppkey % 2 WHEN 0 THEN 'A' ELSE 'a' END || s_suppkey AS old FROM supplier)
SELECT 'm' || module_id AS module_id, anchor FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.module_id = a.module_id AND anchor IN (old, lower(old)))""")
def toc_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the tables of contents, less ids that were rewritten."""
    anchors = table(spark, sf_dir, "part").select(F.expr("concat('m', p_size % 5)").alias("module_id"), F.expr("CASE WHEN p_size % 7 > 0 THEN concat('JD_A', p_partkey % 300) ELSE 'JD_' END").alias("name"))
    renamed = table(spark, sf_dir, "supplier").select(F.expr("concat('m', s_suppkey % 5)").alias("module_id"), F.expr("concat(CASE s_suppkey % 2 WHEN 0 THEN 'A' ELSE 'a' END, s_suppkey)").alias("old_id"))
    return B.toc_anchors(anchors, renamed)


@query("""SELECT doc_id, pos, len(string_split(left(text, pos), chr(10))) AS line FROM (SELECT doc_id, text, unnest(list_filter(range(0, length(text)), lambda i: text[i + 1] = chr(10))) AS pos FROM (SELECT doc_id, text FROM documents WHERE contains(text, chr(10))))""")
def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of paragraph breaks in whole texts, with their lines."""
    found = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(B.paragraph_breaks(F.col("text"))).alias("pos"))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), B.line_number(F.col("text"), F.col("pos")).cast("long").alias("line"))


@query(f"""WITH {_BOXES_SQL}, s AS (SELECT *, CASE WHEN anchor_name IS NOT NULL THEN 'anchor' WHEN {_NUMBERED} THEN 'number' WHEN regexp_matches(lower(heading), 'new\\s+(ordinance|legislation|resolution)') THEN 'New Ordinance/Legislation/Resolution Notice' WHEN heading LIKE '[%]' THEN 'Bracketed caption'
  WHEN regexp_matches(heading, '^[0-9]{{4}}') THEN 'Year label / Ordinances' WHEN regexp_matches(lower(heading), 'zoning|use district|map') THEN 'Map-sheet header' WHEN heading ILIKE 'appendix %' THEN 'Appendix label' WHEN heading ILIKE 'chapter %' THEN 'CHAPTER label' ELSE 'unclassified' END AS bucket
  FROM b WHERE len(list_filter(string_split_regex(class, '\\s+'), lambda x: regexp_matches(x, '{_S}'))) > 0)
SELECT bucket, CASE WHEN bucket NOT IN ('anchor', 'number') THEN heading END AS heading, count(*) AS n FROM s GROUP BY 1, 2""")
def box_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section boxes by what tells their id, and what the others look like."""
    return B.audit(boxes(spark, sf_dir))


@query("""SELECT 'm' || p_size % 5 AS module_id, p_size || '.' || p_partkey % 4 AS anchor, CASE p_partkey % 3 WHEN 0 THEN p_size || '.' || p_partkey % 5 ELSE p_size || 'a-' || p_partkey % 2 END AS heading, count(*) AS n FROM part
WHERE p_partkey % 3 < 2 AND NOT (p_partkey % 3 = 0 AND p_partkey % 5 = p_partkey % 4) GROUP BY 1, 2, 3""")
def anchor_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose labels have another number than their ids, by shape."""
    label = "CASE p_partkey % 3 WHEN 0 THEN concat(p_size, '.', p_partkey % 5, '. Of it') WHEN 1 THEN concat(p_size, 'A-', p_partkey % 2, ' x') ELSE '§ none' END"
    named = table(spark, sf_dir, "part").select(F.expr("concat('m', p_size % 5)").alias("module_id"), F.expr("concat(p_size, '.', p_partkey % 4)").alias("section_id"), F.expr(label).alias("display_label"))
    return B.disagreements(named)


_ANSWER = "concat(p_name, CASE p_size % 3 WHEN 0 THEN '' ELSE chr(10) || chr(10) || CASE p_size % 2 WHEN 0 THEN '**Sources:**' ELSE '### sources' END || chr(10) || '- [Bill #' || (p_partkey + 1000) || '] — x' || chr(10) || '* [m § ' || p_size || ']' || CASE p_size % 5 WHEN 0 THEN '' ELSE chr(10) || 'And ' || p_type END END)"


@query(f"""SELECT p_partkey, CASE WHEN k = 0 THEN a ELSE p_name END AS body, CASE WHEN k = 0 THEN '' ELSE array_to_string(string_split(substr(a, length(p_name) + 3), chr(10))[1:3], chr(10)) END AS block FROM (SELECT p_partkey, p_name, p_size % 3 AS k, {_ANSWER} AS a FROM part)""")
def split_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers parted into prose and their list of sources."""
    return table(spark, sf_dir, "part").select("p_partkey", redline.split_answer(F.expr(_ANSWER)).alias("s")).select("p_partkey", "s.body", "s.block")


_NOTE = "concat(CASE p_partkey % 2 WHEN 0 THEN 'Unchanged  Code text and uncodified text are in plain ' || chr(10) || 'Arial font. ' ELSE '' END, CASE p_partkey % 3 WHEN 0 THEN 'ADDITIONS to Codes are in single-underline italics Times New Roman font. ' ELSE 'Additions to Codes. single-underline italics Times New Roman font.' END, CASE p_partkey % 5 WHEN 0 THEN '' ELSE 'Deletions to Codes are in strikethrough italics Times New Roman font.' END)"


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 1 THEN 'context' END, CASE WHEN p_partkey % 3 > 0 THEN 'insert' END, CASE WHEN p_partkey % 5 = 0 THEN 'delete' END) AS missing, p_size % 2 = 0 OR p_partkey % 4 = 0 AS italic, coalesce(p_size % 3 = 0, false) AS bold, p_partkey % 4 < 2 AS times FROM part""")
def note_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What redline notes fail to tell, and the traits of fonts."""
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'TNR-Oblique' WHEN 1 THEN 'TimesNewRoman' WHEN 2 THEN 'Arial' END")
    traits = redline.font_traits(name, F.expr("CASE WHEN p_size % 2 = 0 THEN true END"), F.expr("p_size % 3 = 0"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(redline.missing_notes(F.expr(_NOTE)), ",").alias("missing"), traits.alias("t")).select("p_partkey", "missing", "t.italic", "t.bold", "t.times")


@query("SELECT doc_id, regexp_replace(replace(text, '. ', ' ' || chr(10) || chr(9) || chr(10) || ' '), '[ \\t]*\\n[ \\t\\n]*', chr(10), 'g') AS text FROM documents")
def collapsed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, in which each sentence ends with ragged line feeds, with one feed each."""
    return table(spark, sf_dir, "documents").select("doc_id", redline.collapsed_feeds(F.replace("text", F.lit(". "), F.lit(" \n\t\n "))).alias("text"))
