"""Cleaning of pages and Markdown: repeated lines, contents tables, pipe tables, sections and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EMPTY_PAGE, line_list, roman_or_arabic, stripped
from ..sources.shared import fixed
from .vectors import BROADCAST_ROWS


def numbered_lines(pages: DataFrame, key: list[str]) -> DataFrame:
    """(key…, pos, line): every line of the text, stripped, whichever way it ends."""
    return pages.select(*key, F.posexplode(line_list(F.col("text"))).alias("pos", "line")).withColumn("line", stripped(F.col("line")))


def without_repeated_lines(pages: DataFrame, doc: str = "doc_id", page: str = "page", threshold: float = 0.7) -> DataFrame:
    """(doc, page, text) less the lines that stand on at least `threshold` of a document's pages.

    Documents of less than three pages lose none, and their texts stay where they are. Blank lines go. A page that keeps
    no line, or has no doc or page, says so.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be within 0 and 1")
    sizes = pages.groupBy(doc).agg(F.count_distinct(page).alias("pages"), F.count("*").alias("rows"))
    compared = fixed(sizes.where((F.col("pages") >= 3) | (F.col("rows") > F.col("pages"))).where(F.col(doc).isNotNull()).select(doc))
    if compared.count() > BROADCAST_ROWS:
        return _less_repeated(pages, doc, page, threshold)
    lines = F.filter(F.transform(line_list(F.col("text")), stripped), lambda x: x != "")
    whole = F.nullif(F.array_join(F.when(F.col(doc).isNotNull() & F.col(page).isNotNull(), lines), "\n"), F.lit(""))
    single = pages.join(F.broadcast(compared), doc, "left_anti").select(doc, page, F.coalesce(whole, F.lit(EMPTY_PAGE)).alias("text"))
    if compared.isEmpty():
        return single
    return single.unionByName(_less_repeated(pages.join(F.broadcast(compared), doc, "left_semi"), doc, page, threshold))


def _less_repeated(pages: DataFrame, doc: str, page: str, threshold: float) -> DataFrame:
    lines = numbered_lines(pages, [doc, page]).where("line <> ''")
    total = pages.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    often = lines.groupBy(doc, "line").agg(F.count_distinct(page).alias("on")).join(total, doc)
    often = often.where((F.col("pages") >= 3) & (F.col("on") >= F.col("pages") * threshold)).select(doc, "line")
    kept = lines.join(often, [doc, "line"], "left_anti").groupBy(doc, page).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("kept"))
    text = F.array_join(F.transform("kept", lambda x: x["line"]), "\n")
    return pages.select(doc, page).join(kept, [doc, page], "left").select(doc, page, F.coalesce(text, F.lit(EMPTY_PAGE)).alias("text"))


# Forms of a contents line in the order in which they are tried, and a contents page's heading.
CONTENTS = [
    r"^(\d+(?:\.\d+)*)\s+(.+?)\.{2,}\s+(\d+)$",
    r"^(\d+(?:\.\d+)*)\s+(.+?)\s+(\d+)$",
    r"^(\d+(?:\.\d+)*)\s+(.+?)\s{2,}(\d+)$",
    r"^(\d+(?:\.\d+)*)[.\s]+(.+?)\s+([IVXivx\d]+)$",
]
CONTENTS_HEADING = r"(?i)^(?:table of contents|contents)$"
CONTENTS_PAGES = 30
#: A line's place in a document is its page times this plus its number.
LINES_A_PAGE = 1 << 32


def contents_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) to (doc_id, pos, line) of each document's contents: the first page with their heading among
    its first ten lines, and the 29 pages after it. Documents without such a page have none."""
    heading = F.exists(F.slice(line_list(F.col("text")), 1, 10), lambda x: stripped(x).rlike(CONTENTS_HEADING))
    first = pages.where(heading).groupBy("doc_id").agg(F.min("page").alias("__first"))
    near = pages.join(first, "doc_id").where(F.col("page").between(F.col("__first"), F.col("__first") + CONTENTS_PAGES - 1))
    lines = near.select("doc_id", "page", F.posexplode(line_list(F.col("text"))).alias("n", "line"))
    return lines.select("doc_id", (F.col("page").cast("long") * LINES_A_PAGE + F.col("n")).alias("pos"), stripped(F.col("line")).alias("line"))


def contents_entries(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, line) to (doc_id, pos, number, title, page, level) of the lines that are contents entries.

    The first form that a line has decides; if that form's page is no number, the line is no entry. Of entries with one
    number and page the last gives the title and the first the place.
    """
    form = F.lit(None).cast("struct<number:string,title:string,raw:string>")
    for pattern in reversed(CONTENTS):
        part = lambda k: F.regexp_extract("line", pattern, k)  # noqa: B023, E731
        form = F.when(F.col("line").rlike(pattern), F.struct(part(1).alias("number"), part(2).alias("title"), part(3).alias("raw"))).otherwise(form)
    out = lines.withColumn("f", form).where("f IS NOT NULL").withColumn("page", roman_or_arabic(F.col("f.raw"))).where("page IS NOT NULL")
    out = out.groupBy("doc_id", F.col("f.number").alias("number"), "page").agg(F.min("pos").alias("pos"), F.trim(F.max_by("f.title", "pos")).alias("title"))
    return out.select("doc_id", "pos", "number", "title", "page", F.size(F.split("number", "\\.")).alias("level"))


def contents(pages: DataFrame) -> DataFrame:
    """(doc_id, page, path): the section that each page of a document with contents lies in."""
    entries = contents_paths(contents_entries(contents_lines(pages)))
    last = pages.groupBy("doc_id").agg(F.count_distinct("page").cast("int").alias("last_page"))
    return page_sections(entries.join(last, "doc_id"), F.col("last_page"))


def contents_paths(entries: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Adds path: the titles from the top level down, by the nearest earlier entry of a lower level.

    Of each level the last entry before a row is carried along the order of a document. It is on the row's path if its
    level is lower than the row's and it comes after the last entries of all lower levels. A row costs as many steps as
    there are levels, however many entries come before it. The levels are looked up unless they are given.
    """
    if levels is None:
        levels = sorted(r["level"] for r in entries.select("level").distinct().collect())  # as many as numbers have parts
    if not levels:
        return entries.withColumn("path", F.lit(None).cast("string"))
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = entries.withColumn("__at", F.row_number().over(order))
    last = [F.last(F.when(F.col("level") == n, F.struct(F.lit(n).alias("level"), "__at", "title")), ignorenulls=True).over(before) for n in levels]
    rows = rows.withColumn("__last", F.array(*last))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("titles"))
    on = lambda at, e: F.when(e.isNotNull() & (e["__at"] > at["at"]), F.struct(e["__at"].alias("at"), F.concat(at["titles"], F.array(e["title"])).alias("titles"))).otherwise(at)
    above = F.aggregate(F.filter("__last", lambda e: e["level"] < F.col("level")), start, on, lambda at: at["titles"])
    return rows.withColumn("path", F.array_join(F.concat(above, F.array("title")), " / ")).drop("__at", "__last")


def page_sections(entries: DataFrame, last_page: Column) -> DataFrame:
    """(doc_id, page, path) for every page from an entry's to the one before the next entry's; the first entry wins."""
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    end = F.coalesce(F.lead("page").over(order) - 1, last_page)
    pages = entries.withColumn("end", end).where("end >= page").select("doc_id", "pos", "path", F.explode(F.sequence("page", "end")).alias("page"))
    first = Window.partitionBy("doc_id", "page").orderBy("pos")
    return pages.withColumn("n", F.row_number().over(first)).where("n = 1").select("doc_id", "page", "path")


def section_as_of(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, page) with the path of the last entry at or before the page, else of the first entry.

    Entries and pages are laid in one order and each page looks back, so the as-of join is one shuffle by document.
    """
    rows = pages.select("doc_id", "page", F.lit(None).cast("string").alias("path"), F.lit(1).alias("is_page")).unionByName(entries.select("doc_id", "page", "path", F.lit(0).alias("is_page")))
    order = Window.partitionBy("doc_id").orderBy("page", "is_page").rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy("doc_id").orderBy("page", "is_page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.coalesce(F.last("path", ignorenulls=True).over(order), F.first("path", ignorenulls=True).over(first))
    return rows.withColumn("path", found).where("is_page = 1").select("doc_id", "page", "path")


def _cells(line: Column, between: str) -> Column:
    return F.transform(F.split(line, between), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))


def _rendered(blocks: DataFrame, key: list[str]) -> DataFrame:
    """(key…, place, rows) to the tables among them, with width and markdown. The first row is the header; rows are filled
    up to the widest; bars within cells are escaped. What has one column or no cell below the header is no table."""
    blocks = blocks.where(F.size("rows") >= 2).withColumn("width", F.array_max(F.transform("rows", lambda r: F.size(r)))).where("width >= 2")
    blocks = blocks.where(F.exists(F.slice("rows", 2, F.size("rows")), lambda r: F.exists(r, lambda c: c != "")))
    escaped = lambda cells: F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.concat(escaped(cells), F.array_repeat(F.lit(""), F.col("width") - F.size(cells))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    text = blocks.withColumn("text", F.transform("rows", row))
    return text.select(*key, "place", "width", F.array_join(F.concat(F.slice("text", 1, 1), F.array(rule), F.slice("text", 2, F.size("text"))), "\n").alias("markdown"))


def _pipe_blocks(lines: DataFrame, key: list[str]) -> DataFrame:
    bars = lines.where(F.col("line").contains("|"))
    bars = bars.withColumn("place", F.col("pos") - F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
    rows = bars.groupBy(*key, "place").agg(F.sort_array(F.collect_list(F.struct("pos", _cells(F.trim("line"), r"\|").alias("cells")))).alias("rows"))
    return rows.withColumn("rows", F.transform("rows", lambda r: r["cells"]))


def pipe_tables(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key…, pos, line) to (key…, table_no, width, markdown) of every block of at least two consecutive lines with a bar.

    Cells are what stands between bars, so a line that begins with a bar has an empty first cell; rules are rows as well.
    """
    found = _rendered(_pipe_blocks(lines, key), key)
    no = F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    return found.withColumn("table_no", no).select(*key, "table_no", "width", "markdown")


def page_tables(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) to (doc_id, page, table_id, width, markdown): a page's pipe tables, then, as one table, all its
    lines with columns set apart by two blanks or more, if there are at least two such lines."""
    key = ["doc_id", "page"]
    lines = pages.select(*key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    spaced = lines.where(F.col("line").rlike(r"\S\s{2,}\S")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", _cells(F.trim("line", F.lit(" \t\r\x0b\f")), r"\s{2,}").alias("cells")))).alias("rows"))
    spaced = spaced.select(*key, F.lit((1 << 31) - 1).alias("place"), F.transform("rows", lambda r: r["cells"]).alias("rows"))
    found = _rendered(_pipe_blocks(lines, key).unionByName(spaced), key)
    no = F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-t"), no.cast("string"))
    return found.withColumn("table_id", name).select(*key, "table_id", "width", "markdown")


def markdown_title(text: Column, fallback: Column) -> Column:
    """The first heading of the first level, else the fallback."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^# (.*)$", 1)), F.lit("")), fallback)


def markdown_sections(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, line) to (doc_id, section_no, level, title, path, content); text before the first heading goes."""
    heading = r"^(#{1,6})\s+(.*)$"
    marked = lines.withColumn("level", F.when(F.col("line").rlike(heading), F.length(F.regexp_extract("line", heading, 1))))
    marked = marked.withColumn("section_no", F.count("level").over(Window.partitionBy("doc_id").orderBy("pos"))).where("section_no > 0")
    body = F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct("pos", "line", "level"))), lambda x: x["level"].isNull()), lambda x: x["line"]), "\n")
    out = marked.groupBy("doc_id", "section_no").agg(F.max("level").alias("level"), F.max(F.when(F.col("level").isNotNull(), F.trim(F.regexp_extract("line", heading, 2)))).alias("title"), body.alias("content"))
    paths = contents_paths(out.select("doc_id", F.col("section_no").alias("pos"), F.lit(0).alias("page"), "level", "title"), [1, 2, 3, 4, 5, 6])
    return out.join(paths.select("doc_id", F.col("pos").alias("section_no"), "path"), ["doc_id", "section_no"]).withColumn("content", F.trim("content", F.lit(" \t\r\n")))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, line) to (doc_id, block, text): plain lines that follow each other become one paragraph.

    Headings, table lines and everything within code fences stay lines of their own; a list item takes the plain lines
    that follow it; blank lines part paragraphs and go.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    fence = F.col("line").startswith("```")
    df = lines.withColumn("fences", F.count_if(fence).over(order)).withColumn("code", (F.col("fences") % 2 == 1) | fence)
    item = F.col("line").rlike(r"^(?:[-*+•]|\d+[.)])\s+")
    kind = F.when(F.col("code"), "own").when(F.col("line") == "", "blank").when(F.col("line").rlike(r"^#{1,6}\s") | F.col("line").contains("|"), "own").when(item, "item").otherwise("plain")
    df = df.withColumn("kind", kind).withColumn("before", F.lag("kind").over(order))
    starts = (F.col("kind") != "plain") | F.coalesce(F.col("before").isin("own", "blank"), F.lit(True))
    df = df.withColumn("block", F.count_if(starts).over(order)).where("kind <> 'blank'")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")
    return df.groupBy("doc_id", "block").agg(joined.alias("text"))
