"""The path-shaped query API: ``read(path)`` and ``search(query)`` over a corpus of DataFrames.

A path is routed in Python to a declared plan; nothing is computed until the result is used.
Listings are capped, and each row carries the total that the cap cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import canonical_number, natural_key, normal_term, root_label
from corpusloom.operators import bill_structure, diff
from corpusloom.operators import outcomes as O
from corpusloom.operators.references import first_seen
from corpusloom.plans.registry import Registry
from corpusloom.plans import structure, texts
from corpusloom.plans.search import search
from corpusloom.sources import bridge
from corpusloom.sources.bridge import CITATIONS_SQL, OUTCOMES_SQL, SECTIONS_SQL, table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql

#: Caps of listings and inputs.
LIST_CAP, HIT_CAP, PATH_LENGTH, QUERY_LENGTH, ISSUES = 50, 25, 512, 200, 3
#: Kinds of changes, in the order of a bill's impact.
CHANGES = ("added", "revised", "referenced_no_change", "unclear")


#: Years that a path may name.
YEARS = (1900, 2200)


class NotFound(LookupError):
    """No such path."""


class BadInput(ValueError):
    """The path or the query breaks a limit."""


@dataclass
class Corpus:
    """The tables that paths lead to: sections, citations, bills (with status), outcomes, ordinances that sections name, definitions."""

    sections: DataFrame
    citations: DataFrame
    bills: DataFrame
    outcomes: DataFrame
    ordinances: DataFrame
    definitions: DataFrame
    blocks: DataFrame | None = None  # of bills: as of operators.bill_structure
    bodies: DataFrame | None = None  # file_no, section_id, text: what bills make of sections
    chunks: DataFrame | None = None  # file_no, section_id, chunk_index, op, text

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Corpus:
        bills = bridge.bills(spark, sf_dir).withColumn("status", O.bill_status(F.col("status_text")))
        sections = bridge.sections(spark, sf_dir)
        definitions = sections.select("module_id", "section_id", "doc_id", normal_term("title").alias("term"))
        return cls(sections, bridge.citations(spark, sf_dir), bills, bridge.outcomes(spark, sf_dir, arrivals=True), texts.ordinances(spark, sf_dir), definitions)

    def recent_ordinances(self, module: str | None = None, year: int | None = None, limit: int | None = None) -> DataFrame:
        """Ordinances, newest first: by the first known date (unknown ones last), then year, then number; each with how many sections name it."""
        rows = self.ordinances
        rows = rows if module is None else rows.where(F.col("source") == module)
        rows = rows if year is None else rows.where(F.col("year") == year)
        known = F.min_by("approved", F.when(F.col("approved").isNotNull(), F.col("doc_id"))).alias("approved_at")
        rows = rows.groupBy("number").agg(F.min("year").alias("year"), known, F.count("*").alias("n_cited_in"))
        order = (F.desc_nulls_last("approved_at"), F.desc("year"), F.desc(F.split_part("number", F.lit("-"), F.lit(1)).cast("long")), "number")
        return rows.orderBy(*order) if limit is None else self._listed(rows, *order, cap=limit)

    def _listed(self, rows: DataFrame, *order, cap: int = LIST_CAP) -> DataFrame:
        total = rows.agg(F.count("*").alias("total"))
        return rows.orderBy(*order).limit(cap).join(F.broadcast(total)).withColumn("truncated", F.col("total") > cap)  # one row

    def _section(self, module: str, section: str) -> DataFrame:
        return self.sections.where((F.col("module_id") == module) & (F.col("section_id") == section.lower()))

    def read(self, path: str) -> DataFrame:
        """The rows at a path; slashes at its ends are ignored, an empty one is the root."""
        if len(path) > PATH_LENGTH:
            raise BadInput(f"a path has at most {PATH_LENGTH} characters")
        match [p for p in path.split("/") if p]:
            case []:
                roots = [(r,) for r in ("bills", "definitions", "modules", "ordinances")]
                return self.sections.sparkSession.createDataFrame(roots, "name string")
            case ["bills"]:
                listed = self._listed(self.bills.select("file_no", "sponsor", "status", "introduced"), F.desc_nulls_last("introduced"), "file_no")
                counts = self.outcomes.join(listed.select("file_no"), "file_no", "left_semi").groupBy("file_no").agg(F.count("*").alias("n_outcomes"), F.count_if(F.col("status") == "anchored").alias("n_anchored"))
                return listed.join(counts, "file_no", "left").orderBy(F.desc_nulls_last("introduced"), "file_no")
            case ["bills", file_no] if file_no.isdigit():
                # of a bill's slices the first stands for it
                return self.bills.where(F.col("file_no") == int(file_no)).orderBy(*(c for c in ("module_id", "sponsor") if c in self.bills.columns)).limit(1)
            case ["bills", file_no, "proposed-text"] if file_no.isdigit() and self.blocks is not None:
                return self.proposed_text(int(file_no))
            case ["bills", file_no, "diff", module, section] if file_no.isdigit() and self.chunks is not None:
                return self.section_diff(int(file_no), module, section)
            case ["bills", file_no, "changes"] if file_no.isdigit():
                return self.outcomes.drop("arrival").where(F.col("file_no") == int(file_no)).orderBy("position", "section_id")
            case ["bills", file_no, "changes", module, section] if file_no.isdigit():
                one = self._section(module, section).select(F.col("doc_id").alias("section_id"), "module_id", "title", F.col("text").alias("baseline"))
                return self.outcomes.drop("arrival").where(F.col("file_no") == int(file_no)).join(one, "section_id").orderBy("position")
            case ["bills", file_no, "impact"] if file_no.isdigit():
                return self.impact(int(file_no))
            case ["modules"]:
                return self.sections.groupBy("module_id").agg(F.count("*").alias("n_sections")).orderBy("module_id")
            case ["modules", module]:
                return self.sections.where(F.col("module_id") == module).groupBy("module_id").agg(F.count("*").alias("n_sections"), F.countDistinct("article_id").alias("n_articles"))
            case ["modules", module, "articles"]:
                return self.sections.where(F.col("module_id") == module).groupBy("article_id").agg(F.count("*").alias("n_sections"), F.min_by("title", "doc_id").alias("title")).orderBy("article_id")
            case ["modules", module, "articles", article]:
                return self.sections.where((F.col("module_id") == module) & (F.lower("article_id") == article.lower())).orderBy(natural_key(F.col("section_id")), "section_id")
            case ["modules", module, "sections", section]:
                return self._section(module, section)
            case ["modules", module, "sections", section, "references"]:
                one = self._section(module, section).select(F.col("doc_id").alias("citing_id"))
                return self.citations.join(one, "citing_id", "left_semi").select("citation_index", "cited_id", "target_kind").orderBy("citation_index", "cited_id")
            case ["modules", module, "sections", section, "history"]:
                one = self._section(module, section).select("doc_id")
                return self.ordinances.join(one, "doc_id", "left_semi").select("number", "year", "file", "approved").orderBy(F.desc_nulls_last("approved"), "number")
            case ["modules", module, "definitions", *term] if term:
                return self.definitions.where((F.col("module_id") == module) & (F.col("term") == normal_term(F.lit(" ".join(term))))).orderBy("doc_id")
            case ["definitions", *term] if term:
                return self.definitions.where(F.col("term") == normal_term(F.lit(" ".join(term)))).orderBy("module_id", "doc_id")
            case ["definitions"]:
                return self._listed(self.definitions.groupBy("term").agg(F.count("*").alias("n")), "term")
            case ["ordinances"]:
                return self.recent_ordinances(limit=LIST_CAP)
            case ["ordinances", year]:
                if not year.isdigit() or not YEARS[0] <= int(year) <= YEARS[1]:
                    raise BadInput(f"a year lies between {YEARS[0]} and {YEARS[1]}")
                return self.recent_ordinances(year=int(year), limit=LIST_CAP)
            case ["modules", module, "sections", section, "cited-by"]:
                one = self._section(module, section).select(F.col("doc_id").alias("cited_id"))
                return self.citations.join(one, "cited_id", "left_semi").select("citing_id").distinct().orderBy("citing_id")
            case ["modules", module, "sections", section, "dependencies"]:
                return self.dependencies(module, section)
            case ["modules", module, "sections", section, "reader"]:
                return self.reader(module, section)
            case ["summary"]:
                return self.summary()
            case ["modules", module, "sections", section, "amendments"]:
                one = self._section(module, section).select(F.col("doc_id").alias("section_id"))
                touched = self.outcomes.join(one, "section_id", "left_semi").select("file_no").distinct()
                return self.bills.join(touched, "file_no").orderBy(F.desc_nulls_last("introduced"), "file_no")
        raise NotFound(path)

    def dependencies(self, module: str, section: str) -> DataFrame:
        """All that a section depends on and that depends on it, one row each: part, module_id, section_id, title, installed, path, note.

        Parts: outbound (sections that it cites, each once; ``installed`` tells whether the corpus has them), inbound (sections that cite
        it), term (sections of any module that define its term), article (its siblings; note: their status) and bill (bills that touch
        it: note, their status). Rows, so that a section that everything cites is no one value.
        """
        one = self._section(module, section)
        at = one.select("doc_id")
        own = self.sections.select("doc_id", "module_id", "section_id", "title")
        path = F.concat_ws("/", F.lit(""), F.lit("modules"), "module_id", F.lit("sections"), "section_id")
        none = F.lit(None).cast("string")

        def part(name: str, rows: DataFrame, note=none, where=path) -> DataFrame:
            return rows.select(F.lit(name).alias("part"), "module_id", "section_id", "title", F.col("module_id").isNotNull().alias("installed"), F.when(F.col("module_id").isNotNull(), where).alias("path"), note.cast("string").alias("note"))

        cited = self.citations.join(at, F.col("citing_id") == F.col("doc_id"), "left_semi").select(F.col("cited_id").alias("doc_id")).distinct()
        out = cited.join(own, "doc_id", "left").withColumn("section_id", F.coalesce("section_id", F.col("doc_id").cast("string")))
        citing = self.citations.join(at, F.col("cited_id") == F.col("doc_id"), "left_semi").select(F.col("citing_id").alias("doc_id")).distinct()
        terms = self.definitions.join(self.definitions.join(at, "doc_id", "left_semi").select("term").distinct(), "term", "left_semi").withColumn("title", F.col("term"))
        article = self.sections.join(one.select("module_id", "article_id", F.col("doc_id").alias("_own")), ["module_id", "article_id"]).where("doc_id <> _own")
        touched = self.outcomes.join(at, F.col("section_id") == F.col("doc_id"), "left_semi").select("file_no").distinct()
        bills = self.bills.join(touched, "file_no").select(F.lit(None).cast("string").alias("module_id"), F.lit(None).cast("string").alias("section_id"), F.col("sponsor").alias("title"), "file_no", "status")
        bills = bills.select(F.lit("bill").alias("part"), "module_id", "section_id", "title", F.lit(True).alias("installed"), F.concat(F.lit("/bills/"), "file_no").alias("path"), F.col("status").alias("note"))
        rows = part("outbound", out)
        for more in (part("inbound", citing.join(own, "doc_id")), part("term", terms), part("article", article, F.col("editorial_status")), bills):
            rows = rows.unionByName(more)
        return rows

    def reader(self, module: str, section: str) -> DataFrame:
        """A section with what a reader shows around it: its article, its neighbours in reading order, and how many definitions it makes."""
        here = self.sections.where(F.col("module_id") == module).select("module_id", "section_id", "title", "text", "article_id", "chapter", "editorial_status", natural_key(F.col("section_id")).alias("_at"))
        one = here.where(F.col("section_id") == section.lower())
        at = F.broadcast(one.select(F.col("_at").alias("_own")).limit(1))  # one row
        near = here.join(at).agg(F.max_by("section_id", F.when(F.col("_at") < F.col("_own"), F.col("_at"))).alias("previous"), F.min_by("section_id", F.when(F.col("_at") > F.col("_own"), F.col("_at"))).alias("following"))
        made = self.definitions.where((F.col("module_id") == module) & (F.col("section_id") == section.lower())).agg(F.count("*").alias("n_definitions"))
        return one.drop("_at").join(F.broadcast(near)).join(F.broadcast(made))  # one row each

    def summary(self) -> DataFrame:
        """Modules with their sections, articles and definitions."""
        counts = self.sections.groupBy("module_id").agg(F.count("*").alias("n_sections"), F.countDistinct("article_id").alias("n_articles"))
        return counts.join(self.definitions.groupBy("module_id").agg(F.count("*").alias("n_definitions")), "module_id", "left").fillna(0, ["n_definitions"]).orderBy("module_id")

    def impact(self, file_no: int) -> DataFrame:
        """Sections that a bill touches, by kind of change, with the bill's counts and flags; ``cross_module`` tells whether they lie in several modules."""
        rows = first_seen(self.outcomes.where(F.col("file_no") == file_no), ["section_id"], ["position"]).withColumn("kind", O.change_kind(F.col("status")))
        own = self.sections.select(F.col("doc_id").alias("section_id"), "module_id")
        rows = rows.join(own, "section_id", "left")
        count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
        totals = rows.agg(*(count(k) for k in CHANGES), F.sum("n_words").alias("bill_words"), (F.countDistinct("module_id") > 1).alias("cross_module"), F.bool_or(F.col("status").isin("unresolved", "no_baseline")).alias("incomplete"))
        order = F.array_position(F.array(*map(F.lit, CHANGES)), F.col("kind"))
        return self._listed(rows, order, "section_id").join(F.broadcast(totals))  # one row

    def proposed_text(self, file_no: int) -> DataFrame:
        """A bill's preamble, what it does to each code with its text, and its end: place, kind, text, in order."""
        blocks = self.blocks.where(F.col("file_no") == file_no)
        head = F.when(F.col("kind") == "code_section_header", F.concat(F.lit("SEC. "), "number", F.lit(". "), "text")).otherwise(F.concat_ws("\n\n", F.when(F.col("opens"), F.concat(F.lit("("), "marker", F.lit(")"))), "text"))
        before = Window.partitionBy("file_no", "group_no", "header_no").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        opens = F.col("marker").isNotNull() & ~F.coalesce(F.max("subsection").over(before) == F.col("subsection"), F.lit(False))
        lines = blocks.withColumn("opens", opens).withColumn("line", head)
        bodies = lines.where("header_no is not null").groupBy("group_no").agg(F.array_sort(F.collect_list(F.struct("header_no", "place", "line"))).alias("x"))
        bodies = bodies.select((2 * F.col("group_no")).alias("place"), F.lit("text").alias("kind"), F.array_join(F.transform("x", lambda r: r["line"]), "\n\n").alias("text"))
        place = F.when(F.col("kind") == "preamble", 0).when(F.col("kind") == "closing", 2**31 - 1).otherwise(2 * F.col("group_no") - 1)
        ends = blocks.where("kind in ('preamble', 'action', 'closing')").select(place.alias("place"), "kind", "text")
        return ends.unionByName(bodies).orderBy("place")

    def section_diff(self, file_no: int, module: str, section: str) -> DataFrame:
        """What a bill does to a section: status, baseline, proposed (the baseline where it has no new body) and its chunks, in order."""
        one = self._section(module, section).select(F.col("doc_id").alias("section_id"), F.col("text").alias("baseline"))
        named = first_seen(self.outcomes.where(F.col("file_no") == file_no).join(one, "section_id"), ["section_id"], ["position"]).select("file_no", "section_id", "status", "baseline")
        ours = lambda rows: rows.where(F.col("file_no") == file_no).drop("file_no")
        chunks = ours(self.chunks).groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "op", "text"))).alias("chunks"))
        told = named.join(ours(self.bodies).withColumnRenamed("text", "proposed"), "section_id", "left").join(chunks, "section_id", "left")
        return told.withColumns({"proposed": F.coalesce("proposed", "baseline", F.lit("")), "chunks": F.coalesce("chunks", F.array().cast("array<struct<chunk_index:int,op:string,text:string>>"))})

    def answer(self, path: str) -> DataFrame:
        """The rows at a path as evidence, or one row that says why there are none: ok, code, message, issues, evidence.

        Codes: not_found (no such path, module, section or bill), bad_input (with at most three issues), internal.
        """
        spark = self.sections.sparkSession
        schema = "ok boolean, code string, message string, issues array<string>, evidence string"

        def failed(code: str, message: str, issues: list[str]) -> DataFrame:
            return spark.createDataFrame([(False, code, message, issues[:ISSUES], None)], schema)

        try:
            rows = self.read(path)
            parts = [p for p in path.split("/") if p]
            for named, there in ((parts[:1] == ["modules"] and len(parts) > 1, lambda: self.sections.where(F.col("module_id") == parts[1])), (parts[:1] == ["bills"] and len(parts) > 1, lambda: self.bills.where(F.col("file_no") == int(parts[1]))),
                                 (parts[:1] == ["modules"] and parts[2:3] == ["sections"] and len(parts) > 3, lambda: self._section(parts[1], parts[3]))):
                if named and there().isEmpty():
                    raise NotFound(path)
        except NotFound as e:
            return failed("not_found", f"nothing at {e}", [])
        except BadInput as e:
            return failed("bad_input", str(e), str(e).split("; "))
        except Exception as e:  # noqa: BLE001 - whatever else went wrong is told, not raised
            return failed("internal", type(e).__name__, [])
        none = F.lit(None)
        return envelope(rows).select(F.lit(True).alias("ok"), none.cast("string").alias("code"), none.cast("string").alias("message"), none.cast("array<string>").alias("issues"), "evidence")

    def search(self, text: str) -> DataFrame:
        if not 1 <= len(text) <= QUERY_LENGTH:
            raise BadInput(f"a query has 1 to {QUERY_LENGTH} characters")
        return search(self.sections, text, HIT_CAP)


def envelope(rows: DataFrame) -> DataFrame:
    """Each row as evidence for a model: JSON between fixed tags."""
    return rows.select(F.concat(F.lit("<corpus_evidence>"), F.to_json(F.struct(*rows.columns)), F.lit("</corpus_evidence>")).alias("evidence"))


@query(f"""WITH {SECTIONS_SQL} SELECT module_id, count(*) AS n_sections FROM sections GROUP BY 1""")
def read_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus.of(spark, sf_dir).read("/modules")


@query(f"""WITH {SECTIONS_SQL} SELECT article_id, count(*) AS n_sections, first(title ORDER BY doc_id) AS title FROM sections WHERE module_id = 'src1' GROUP BY 1""")
def read_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus.of(spark, sf_dir).read("/modules/src1/articles/")


@query(f"""WITH {SECTIONS_SQL}, {CITATIONS_SQL} SELECT DISTINCT citing_id FROM citations JOIN sections ON doc_id = cited_id WHERE module_id = 'src1' AND section_id = '1.0'""")
def read_cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus.of(spark, sf_dir).read("modules/src1/sections/1.0/cited-by")


@query(f"""WITH {OUTCOMES_SQL}, b AS (SELECT min(file_no) AS file_no FROM outcomes) SELECT file_no, section_id, position, status, n_words FROM outcomes JOIN b USING (file_no)""")
def read_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the first bill; its number comes from one aggregated row."""
    corpus = Corpus.of(spark, sf_dir)
    first = corpus.outcomes.agg(F.min("file_no")).first()[0]
    return corpus.read(f"/bills/{first}/changes")


@query(f"""WITH {bridge.BILLS_SQL}, {OUTCOMES_SQL}, t AS (SELECT DISTINCT file_no FROM outcomes JOIN documents ON doc_id = section_id WHERE source = 'src1' AND doc_id = 1)
SELECT file_no, sponsor, status_text, introduced, status FROM states JOIN t USING (file_no)""")
def read_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus.of(spark, sf_dir).read("/modules/src1/sections/1.0/amendments")


@query(f"""WITH {texts.ORDINANCES_SQL}, o AS (SELECT number, min(year) AS year, arg_min(approved, doc_id) FILTER (approved IS NOT NULL) AS approved_at, count(*) AS n_cited_in FROM i GROUP BY number)
SELECT *, (SELECT count(*) FROM o) AS total, (SELECT count(*) FROM o) > 50 AS truncated FROM o ORDER BY approved_at DESC NULLS LAST, year DESC, CAST(split_part(number, '-', 1) AS BIGINT) DESC, number LIMIT 50""")
def read_ordinances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus.of(spark, sf_dir).read("/ordinances")


@query(f"""WITH {SECTIONS_SQL}, {texts.ORDINANCES_SQL} SELECT number, year, file, approved FROM i JOIN sections s USING (doc_id) WHERE module_id = 'src1' AND section_id = '1.0'""")
def read_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinances in the history of a section."""
    return Corpus.of(spark, sf_dir).read("/modules/src1/sections/1.0/history")


@query(f"""WITH {SECTIONS_SQL}, d AS (SELECT module_id, section_id, doc_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS term FROM sections), t AS (SELECT term, count(*) AS n FROM d GROUP BY 1)
SELECT *, (SELECT count(*) FROM t) AS total, (SELECT count(*) FROM t) > 50 AS truncated FROM t ORDER BY term LIMIT 50""")
def read_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in order, as far as the list goes."""
    return Corpus.of(spark, sf_dir).read("/definitions")


@query(f"""WITH {CITATIONS_SQL} SELECT citation_index, cited_id, target_kind FROM citations WHERE citing_id = 1""")
def read_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus.of(spark, sf_dir).read("/modules/src1/sections/1.0/references")


@query(f"""WITH {SECTIONS_SQL}, {OUTCOMES_SQL}, f AS (SELECT min(file_no) AS file_no FROM outcomes WHERE section_id = 1)
SELECT o.section_id, o.file_no, position, status, n_words, module_id, title, text AS baseline FROM outcomes o JOIN f ON o.file_no = f.file_no JOIN sections s ON s.doc_id = o.section_id WHERE doc_id = 1""")
def read_bill_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first bill on a section does to it, beside the text in force."""
    corpus = Corpus.of(spark, sf_dir)
    first = corpus.outcomes.where("section_id = 1").agg(F.min("file_no")).first()[0]
    return corpus.read(f"/bills/{first}/changes/src1/1.0")


@query("""SELECT c_custkey, '12a.' || c_custkey AS number, c_name AS root, lower(trim(regexp_replace(c_mktsegment || '  ' || c_name || ' ', '\\s+', ' ', 'g'))) AS term FROM customer""")
def lookup_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, jurisdictions and terms in the forms in which they are looked up."""
    c = table(spark, sf_dir, "customer")
    raw = (canonical_number(F.concat(F.lit("§ 12A . "), "c_custkey")).alias("number"), root_label(F.concat(F.lit("City and County of "), "c_name")).alias("root"), normal_term(F.concat("c_mktsegment", F.lit("  "), "c_name", F.lit(" "))).alias("term"))
    return c.select("c_custkey", *raw)


_AT = "SELECT doc_id, article_id FROM sections WHERE module_id = 'src1' AND section_id = '1.0'"


@query(f"""WITH {SECTIONS_SQL}, {CITATIONS_SQL}, {OUTCOMES_SQL}, {bridge.BILLS_SQL}, here AS ({_AT}), d AS (SELECT *, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS term FROM sections),
x AS (SELECT DISTINCT 'outbound' AS part, s.module_id, coalesce(s.section_id, CAST(cited_id AS VARCHAR)) AS section_id, title, NULL AS note FROM citations LEFT JOIN sections s ON s.doc_id = cited_id WHERE citing_id IN (SELECT doc_id FROM here)
UNION ALL SELECT DISTINCT 'inbound', module_id, section_id, title, NULL FROM citations JOIN sections ON doc_id = citing_id WHERE cited_id IN (SELECT doc_id FROM here)
UNION ALL SELECT 'term', module_id, section_id, term, NULL FROM d WHERE term IN (SELECT term FROM d WHERE doc_id IN (SELECT doc_id FROM here))
UNION ALL SELECT 'article', module_id, section_id, title, editorial_status FROM sections WHERE module_id = 'src1' AND article_id IN (SELECT article_id FROM here) AND doc_id NOT IN (SELECT doc_id FROM here))
SELECT part, module_id, section_id, title, module_id IS NOT NULL AS installed, CASE WHEN module_id IS NOT NULL THEN '/modules/' || module_id || '/sections/' || section_id END AS path, note FROM x
UNION ALL SELECT 'bill', NULL, NULL, sponsor, true, '/bills/' || file_no, status FROM states WHERE file_no IN (SELECT file_no FROM outcomes WHERE section_id IN (SELECT doc_id FROM here))""")
def read_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that depends on a section and that it depends on."""
    return Corpus.of(spark, sf_dir).read("/modules/src1/sections/1.0/dependencies")


@query(f"""WITH {SECTIONS_SQL}, k AS (SELECT *, CAST(split_part(section_id, '.', 1) AS INTEGER) AS a, CAST(split_part(section_id, '.', 2) AS INTEGER) AS b FROM sections WHERE module_id = 'src1'), w AS (SELECT *, lag(section_id) OVER (ORDER BY a, b) AS previous, lead(section_id) OVER (ORDER BY a, b) AS following FROM k)
SELECT module_id, section_id, title, text, article_id, chapter, editorial_status, previous, following, CAST(1 AS BIGINT) AS n_definitions FROM w WHERE section_id = '21.0'""")
def read_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section with its neighbours in reading order."""
    return Corpus.of(spark, sf_dir).read("/modules/src1/sections/21.0/reader")


@query(f"""WITH {SECTIONS_SQL} SELECT module_id, count(*) AS n_sections, count(DISTINCT article_id) AS n_articles, count(*) AS n_definitions FROM sections GROUP BY 1""")
def read_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modules of the corpus."""
    return Corpus.of(spark, sf_dir).read("summary")


@query(f"""WITH {OUTCOMES_SQL}, {SECTIONS_SQL}, f AS (SELECT min(file_no) AS f FROM outcomes), r AS (SELECT o.*, CASE WHEN status = 'added_section' THEN 'added' WHEN status = 'anchored' THEN 'revised' WHEN status = 'no_changes' THEN 'referenced_no_change' ELSE 'unclear' END AS kind, module_id
  FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY position) AS k FROM outcomes JOIN f ON file_no = f) o LEFT JOIN sections s ON s.doc_id = o.section_id WHERE k = 1),
t AS (SELECT count(*) AS total, count(*) > 50 AS truncated, count(*) FILTER (kind = 'added') AS n_added, count(*) FILTER (kind = 'revised') AS n_revised, count(*) FILTER (kind = 'referenced_no_change') AS n_referenced_no_change, count(*) FILTER (kind = 'unclear') AS n_unclear,
  CAST(sum(n_words) AS BIGINT) AS bill_words, count(DISTINCT module_id) > 1 AS cross_module, bool_or(status IN ('unresolved', 'no_baseline')) AS incomplete FROM r)
SELECT file_no, section_id, position, status, n_words, kind, module_id, t.* FROM r, t""")
def read_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The impact of the first bill; its number comes from one aggregated row."""
    corpus = Corpus.of(spark, sf_dir)
    return corpus.read(f"/bills/{corpus.outcomes.agg(F.min('file_no')).first()[0]}/impact")


_P = "chr(10) || chr(10)"


@query(f"""WITH {structure._PIECES}, f AS (SELECT min(o_orderkey) AS f FROM b), x AS (SELECT *, 'SEC. ' || number || '. ' || title || {_P} || '((a))' || {_P} || 'First, part ' || l_partkey || ' wrapped.' || {_P} || 'Second one.' || {_P} || CASE WHEN l_suppkey % 3 = 0 THEN '((2))' || {_P} ELSE '' END || '((b))' || {_P} || 'Third ' || l_suppkey AS told FROM b JOIN f ON o_orderkey = f)
SELECT CAST(2 * group_no - 1 AS INTEGER) AS place, 'action' AS kind, trim(regexp_replace(action, '\\s+', ' ', 'g')) AS text FROM x WHERE opens
UNION ALL SELECT CAST(2 * group_no AS INTEGER), 'text', string_agg(told, {_P} ORDER BY k) FROM x GROUP BY group_no
UNION ALL SELECT 0, 'preamble', '[Codes - Order ' || f || ']' || {_P} || 'Ordinance amending codes by adding Chapter ' || f || ';' || {_P} || 'Be it ordained:' FROM f
UNION ALL SELECT DISTINCT 2147483647, 'closing', 'Section 99. Effective Date. In force at once.' || {_P} || 'APPROVED AS TO FORM: Clerk ' || o_custkey FROM x""")
def read_proposed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first bill with amendments proposes."""
    corpus = Corpus.of(spark, sf_dir)
    first = table(spark, sf_dir, "lineitem").agg(F.min("l_orderkey")).first()[0]
    # of all bills only the one that the path names is read
    bills = structure.bill_texts(spark, sf_dir).where(F.col("file_no") == first)
    corpus.blocks = bill_structure.blocks(bills, bill_structure.ranges(bills, raw=True))
    return corpus.read(f"/bills/{first}/proposed-text")


@query(f"""WITH {SECTIONS_SQL}, {OUTCOMES_SQL}, f AS (SELECT min(file_no) AS f FROM outcomes WHERE section_id = 1), o AS (SELECT arg_min(status, position) AS status FROM outcomes JOIN f ON file_no = f WHERE section_id = 1), s AS (SELECT text FROM sections WHERE doc_id = 1)
SELECT f AS file_no, CAST(1 AS BIGINT) AS section_id, status, text AS baseline, text || ' (new)' AS proposed, 'equal:' || length(text) || ' insert:6' AS told FROM f, o, s""")
def read_section_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first bill on a section makes of it."""
    corpus = Corpus.of(spark, sf_dir)
    named = corpus.outcomes.select("file_no", "section_id").distinct()
    corpus.bodies = named.join(corpus.sections.select(F.col("doc_id").alias("section_id"), F.concat("text", F.lit(" (new)")).alias("text")), "section_id")
    pairs = corpus.bodies.join(corpus.sections.select(F.col("doc_id").alias("section_id"), F.col("text").alias("old")), "section_id").withColumn("pair", F.struct("file_no", "section_id"))
    first = corpus.outcomes.where("section_id = 1").agg(F.min("file_no")).first()[0]
    # of all pairs only the one that the path names is compared
    corpus.chunks = diff.diff_chunks(pairs.where((F.col("file_no") == first) & (F.col("section_id") == 1)), "pair", "old", "text").select("pair.*", "chunk_index", "op", "text")
    told = F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["op"], F.length(c["text"]))), " ")
    return corpus.read(f"/bills/{first}/diff/src1/1.0").withColumn("told", told).drop("chunks")
