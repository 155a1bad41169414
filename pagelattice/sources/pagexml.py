"""PAGE-XML as tables: a scan with a fixed schema, its flattened entities, and a writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import page_attributes as attr

_COORDS = "STRUCT<_points: STRING>"
_EQUIV = "ARRAY<STRUCT<Unicode: STRING>>"
_WORD = f"ARRAY<STRUCT<_id: STRING, _custom: STRING, Coords: {_COORDS}, TextEquiv: {_EQUIV}>>"
_LINE = f"ARRAY<STRUCT<_id: STRING, _custom: STRING, Coords: {_COORDS}, Baseline: {_COORDS}, Word: {_WORD}, TextEquiv: {_EQUIV}>>"
_TEXT_REGION = f"ARRAY<STRUCT<_id: STRING, _type: STRING, _custom: STRING, Coords: {_COORDS}, TextLine: {_LINE}, TextEquiv: {_EQUIV}>>"
_REGION = f"ARRAY<STRUCT<_id: STRING, _type: STRING, _custom: STRING, Coords: {_COORDS}>>"
#: The kinds of regions of a PAGE file other than text regions.
OTHER_REGIONS = ("AdvertRegion", "ChartRegion", "ChemRegion", "GraphicRegion", "ImageRegion", "LineDrawingRegion", "MathsRegion", "MusicRegion", "NoiseRegion", "SeparatorRegion", "TableRegion", "UnknownRegion")
#: The attributes of a TranskribusMetadata element.
TRANSKRIBUS = ("docId", "pageId", "pageNr", "tsid", "status", "userId", "imgUrl", "xmlUrl", "imageId")
#: The schema of a PcGts element; never inferred.
SCHEMA = f"""Metadata STRUCT<Creator: STRING, Created: STRING, LastChange: STRING, Comments: STRING, TranskribusMetadata: STRUCT<{", ".join(f"_{a}: STRING" for a in TRANSKRIBUS)}>>,
Page STRUCT<_imageFilename: STRING, _imageWidth: INT, _imageHeight: INT, PrintSpace: STRUCT<Coords: {_COORDS}>, TextRegion: {_TEXT_REGION}, {", ".join(f"{k}: {_REGION}" for k in OTHER_REGIONS)}>, _corrupt_record STRING"""


def read(spark: SparkSession, path: str, xsd: str | None = None) -> DataFrame:
    """A row a PAGE file: path, is_valid, the metadata and the page; a malformed file, and with xsd (a schema's path) one that breaks it, is a row that isn't valid."""
    reader = spark.read.schema(SCHEMA).option("rowTag", "PcGts").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    got = (reader.option("rowValidationXSDPath", xsd) if xsd else reader).xml(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1)
    return got.select(name.alias("page_id"), F.col("_corrupt_record").isNull().alias("is_valid"), "Metadata", "Page")


def pages(scan: DataFrame) -> DataFrame:
    """Image, resolution, metadata and print space (the whole image without one; negative corners are clamped)."""
    whole = geo.corners(F.lit(0), F.lit(0), F.col("Page._imageWidth"), F.col("Page._imageHeight"))
    space = F.transform(geo.points(F.col("Page.PrintSpace.Coords._points")), lambda p: F.struct(F.greatest(p["x"], F.lit(0)).alias("x"), F.greatest(p["y"], F.lit(0)).alias("y")))
    meta = [F.col(f"Metadata.{a}").alias(b) for a, b in (("Creator", "creator"), ("Comments", "comments"), ("TranskribusMetadata", "transkribus"))]
    times = [F.col(f"Metadata.{a}").try_cast("timestamp").alias(b) for a, b in (("Created", "created"), ("LastChange", "last_change"))]
    return scan.select("page_id", "is_valid", F.col("Page._imageFilename").alias("image"), F.col("Page._imageWidth").alias("width"), F.col("Page._imageHeight").alias("height"), F.coalesce(space, whole).alias("print_space"), *meta, *times)


def _text(equiv) -> F.Column:
    """Of several text versions the last."""
    return F.coalesce(F.try_element_at(equiv, F.lit(-1))["Unicode"], F.lit(""))


def text_regions(scan: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text regions in document order; one without a type is a paragraph. keep: columns of the scan that each gets."""
    # outer, as Spark else filters by the regions' number before, and parses the document for it once more
    r = scan.select("page_id", *keep, F.posexplode_outer("Page.TextRegion").alias("pos", "r")).where("pos is not null")
    return r.select("page_id", *keep, "pos", F.col("r._id").alias("region_id"), F.coalesce("r._type", F.lit("paragraph")).alias("region_type"), attr.parse(F.coalesce("r._custom", F.lit(""))).alias("custom"), geo.points(F.col("r.Coords._points")).alias("points"), F.coalesce("r.TextLine", F.array().cast(_LINE)).alias("lines"))


def regions(scan: DataFrame) -> DataFrame:
    """All regions with their kind; only kinds that are there have rows."""
    out = text_regions(scan).select("page_id", F.lit("TextRegion").alias("kind"), "region_id", "region_type", "points", "custom")
    for kind in OTHER_REGIONS:
        r = scan.select("page_id", F.explode(f"Page.{kind}").alias("r"))
        out = out.unionByName(r.select("page_id", F.lit(kind).alias("kind"), F.col("r._id").alias("region_id"), F.col("r._type").alias("region_type"), geo.points(F.col("r.Coords._points")).alias("points"), attr.parse(F.coalesce("r._custom", F.lit(""))).alias("custom")))
    return out


def lines(scan: DataFrame, distinct: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text lines; of lines of one id the first, if distinct. keep: columns of the scan that each gets."""
    l = text_regions(scan, keep).select("page_id", *keep, "region_id", F.col("pos").alias("region_pos"), F.posexplode("lines").alias("pos", "l"))  # noqa: E741
    out = l.select("page_id", *keep, "region_id", "region_pos", "pos", F.col("l._id").alias("line_id"), _text(F.col("l.TextEquiv")).alias("text"), geo.points(F.col("l.Baseline._points")).alias("baseline"), geo.points(F.col("l.Coords._points")).alias("points"), attr.parse(F.coalesce("l._custom", F.lit(""))).alias("custom"), F.col("l.Word").alias("words"))
    found = {"article_id": attr.article_id(F.col("custom")), "reading_order": attr.reading_order(F.col("custom"))}  # of what is parsed once
    out = out.select(*out.columns[:-1], *[c.alias(n) for n, c in found.items()], "words")
    if distinct:
        from pyspark.sql import Window

        first = Window.partitionBy("page_id", "line_id").orderBy("region_pos", "pos")
        out = out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return out


def words(scan: DataFrame) -> DataFrame:
    w = lines(scan).select("page_id", "line_id", F.posexplode("words").alias("pos", "w"))
    return w.select("page_id", "line_id", "pos", F.col("w._id").alias("word_id"), _text(F.col("w.TextEquiv")).alias("text"), geo.points(F.col("w.Coords._points")).alias("points"))


def from_lines(lines_: DataFrame, pages_: DataFrame) -> DataFrame:
    """(page_id, xml): PAGE documents of lines(page_id, region_id, line_id, text, points, baseline, custom text) and pages(page_id, image, width, height)."""
    line = F.struct(F.col("line_id").alias("_id"), F.col("custom").alias("_custom"), F.struct(F.col("points").alias("_points")).alias("Coords"), F.struct(F.col("baseline").alias("_points")).alias("Baseline"), F.array(F.struct(F.col("text").alias("Unicode"))).alias("TextEquiv"))
    region = lines_.groupBy("page_id", "region_id").agg(F.sort_array(F.collect_list(F.struct("line_id", line.alias("l")))).alias("ls"), F.min("points").alias("p"))
    region = region.select("page_id", F.struct(F.col("region_id").alias("_id"), F.struct(F.col("p").alias("_points")).alias("Coords"), F.transform("ls", lambda x: x["l"]).alias("TextLine"), F.array(F.struct(F.array_join(F.transform("ls", lambda x: F.element_at(x["l"]["TextEquiv"], 1)["Unicode"]), "\n").alias("Unicode"))).alias("TextEquiv")).alias("r"))
    page = region.groupBy("page_id").agg(F.sort_array(F.collect_list("r")).alias("TextRegion")).join(pages_, "page_id")
    doc = F.struct(metadata(F.lit("pagelattice"), now()).alias("Metadata"), F.struct(F.col("image").alias("_imageFilename"), F.col("width").alias("_imageWidth"), F.col("height").alias("_imageHeight"), "TextRegion").alias("Page"))
    return page.select("page_id", F.to_xml(doc, {"rowTag": "PcGts"}).alias("xml"))


def now() -> F.Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def metadata(creator, created, comments=None, transkribus=None) -> F.Column:
    """A new document's Metadata: created and last changed at one time; transkribus is a struct with that element's attributes, each under its name behind an underscore."""
    parts = [creator.alias("Creator"), created.alias("Created"), created.alias("LastChange")]
    return F.struct(*parts, *[x.alias(n) for x, n in ((comments, "Comments"), (transkribus, "TranskribusMetadata")) if x is not None])


def changed(metadata_: F.Column, when, comments=None) -> F.Column:
    """Metadata of a document that is written again: the time of the change, and its comments if there are new ones."""
    out = metadata_.withField("LastChange", when)
    return out if comments is None else out.withField("Comments", F.coalesce(comments, metadata_["Comments"]))


def metadata_in_order(xml) -> F.Column:
    """Whether a document has one Metadata whose children are Creator, Created, LastChange, and then at most Comments and TranskribusMetadata."""
    inner = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?Metadata\b[^>]*>(.*?)</(?:\w+:)?Metadata>"), F.lit(1))
    names = F.array_join(F.regexp_extract_all(F.try_element_at(inner, F.lit(1)), F.lit(r"<(?:\w+:)?([A-Za-z]+)\b"), F.lit(1)), ",")
    return F.coalesce((F.size(inner) == 1) & names.rlike("^Creator,Created,LastChange(,Comments)?(,TranskribusMetadata)?$"), F.lit(False))


def write(documents: DataFrame, path: str) -> None:
    """Documents as XML text, a document a line block, dealt by page; read() takes the folder."""
    documents.select("xml").write.mode("overwrite").text(path)


def parse(documents: DataFrame) -> DataFrame:
    """The scan's columns of documents held as text: (page_id, xml); valid are those with a page of a size and metadata in order."""
    got = documents.select("page_id", F.from_xml("xml", SCHEMA, {"rowTag": "PcGts"}).alias("d"), metadata_in_order(F.col("xml")).alias("in_order"))
    sound = F.col("d").isNotNull() & F.col("d.Page").isNotNull() & F.coalesce((F.col("d.Page._imageWidth") > 0) & (F.col("d.Page._imageHeight") > 0), F.lit(False)) & F.col("in_order")
    return got.select("page_id", sound.alias("is_valid"), "d.Metadata", "d.Page")
