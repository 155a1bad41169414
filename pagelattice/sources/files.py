"""JSON, CSV, text and listing sources and sinks with the formats' own schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = """num_nodes INT, interacting_nodes ARRAY<ARRAY<INT>>, num_interacting_nodes INT, node_features ARRAY<ARRAY<FLOAT>>, edge_features ARRAY<ARRAY<FLOAT>>,
visual_regions_nodes ARRAY<ARRAY<ARRAY<FLOAT>>>, gt_relations ARRAY<ARRAY<INT>>, gt_num_relations INT"""
CONFIDENCES = "confidences MAP<STRING, MAP<STRING, STRING>>"
COMPARISON = "dataSet STRING, method STRING, gtXML STRING, hypXML STRING, gtNIs INT, hypNIs INT, corrects INT, splits INT, merges INT, dist INT"
KEYWORDS = "keywords ARRAY<STRUCT<kw: STRING, pos: ARRAY<STRUCT<conf: DOUBLE, bl: STRING, line: STRING, image: STRING>>, time: LONG>>"


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a list file without blanks at their end; empty ones are dropped."""
    return spark.read.text(path).select(F.rtrim("value").alias("path")).where("path <> ''")


def graphs(spark: SparkSession, path: str) -> DataFrame:
    """Layout graphs, a file each."""
    return spark.read.schema(GRAPH).option("multiLine", True).json(path).withColumn("page_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def graph_json(nodes: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """(page_id, json): layout graphs of nodes(page_id, node, features), edges(page_id, src, dst, features) and relations(page_id, i, j); nodes count from 0.

    Pages without nodes have no graph: the pages that a caller skips are those that no row here names.
    """
    listed = lambda df, *c: df.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*c))).alias("l"))
    n = listed(nodes, "node", "features").select("page_id", F.size("l").alias("num_nodes"), F.transform("l", lambda x: x["features"]).alias("node_features"))
    e = listed(edges, "src", "dst", "features").select("page_id", F.transform("l", lambda x: F.array(x["src"], x["dst"])).alias("interacting_nodes"), F.transform("l", lambda x: x["features"]).alias("edge_features"))
    r = listed(relations, "i", "j").select("page_id", F.transform("l", lambda x: F.array(x["i"], x["j"])).alias("gt_relations"))
    whole = n.join(e, "page_id", "left").join(r, "page_id", "left")
    names = [c for c in ("interacting_nodes", "edge_features", "gt_relations")]
    empty = lambda c: F.coalesce(c, F.array().cast("array<array<double>>" if c == "edge_features" else "array<array<int>>")).alias(c)
    out = whole.select("page_id", "num_nodes", "node_features", *[empty(c) for c in names])
    sized = F.struct("num_nodes", "interacting_nodes", F.size("interacting_nodes").alias("num_interacting_nodes"), "node_features", "edge_features", "gt_relations", F.size("gt_relations").alias("gt_num_relations"))
    return out.select("page_id", F.to_json(sized).alias("json"))


def graph_folder(node_dim: int, interaction: str, edge_dim: int, visual: bool, separators: str) -> str:
    """The folder's name for graphs of these features, beside that of the pages."""
    return f"json{node_dim}{interaction[0]}{edge_dim}{'v' if visual else ''}{separators}"


def parsed_graphs(graphs_: DataFrame, node_mask: list[int] | None = None) -> DataFrame:
    """The fields of graphs held as text (page_id, json), of each node the features of the mask's places."""
    got = graphs_.select("page_id", F.from_json("json", GRAPH).alias("g")).select("page_id", "g.*")
    if node_mask is None:
        return got
    return got.withColumn("node_features", F.transform("node_features", lambda f: F.array(*[F.get(f, F.lit(k)) for k in node_mask])))


def confidences(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, a, b, p) of confidence files, whose values are text."""
    got = spark.read.schema(CONFIDENCES).option("multiLine", True).json(path).withColumn("page_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    got = got.select("page_id", F.explode("confidences").alias("a", "row")).select("page_id", "a", F.explode("row").alias("b", "p"))
    return got.withColumn("p", F.col("p").cast("double"))


def confidence_json(conf: DataFrame) -> DataFrame:
    """(page_id, json) of conf(page_id, i, j, p)."""
    rows = conf.groupBy("page_id", F.col("i").cast("string").alias("a")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("j").cast("string").alias("key"), F.col("p").cast("string").alias("value"))))).alias("row"))
    whole = rows.groupBy("page_id").agg(F.map_from_entries(F.sort_array(F.transform(F.collect_list(F.struct("a", F.to_json("row").alias("j"))), lambda x: F.struct(x["a"].alias("key"), x["j"].alias("value"))))).alias("m"))
    return whole.select("page_id", F.to_json(F.struct(F.transform_values("m", lambda _, v: F.from_json(v, "map<string,string>")).alias("confidences"))).alias("json"))


def comparisons(spark: SparkSession, path: str, methods: list[str] | None = None) -> DataFrame:
    """Comparison rows of a CSV file; with methods only theirs (without regard to case)."""
    got = spark.read.schema(COMPARISON).option("header", True).csv(path)
    return got.where(F.lower("method").isin([m.lower() for m in methods])) if methods else got


def write_comparisons(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """(kw, conf, line, image, time), a row a hit."""
    k = spark.read.schema(KEYWORDS).option("multiLine", True).json(path).select(F.explode("keywords").alias("k"))
    return k.select("k.kw", "k.time", F.explode("k.pos").alias("p")).select("kw", "time", "p.conf", "p.bl", "p.line", "p.image")


def nested_blocks(lines: DataFrame) -> DataFrame:
    """(page_id, json): a page's articles and their blocks of text, for lines(page_id, region_no, line_no, gt_id, txt)."""
    blocks = lines.groupBy("page_id", "gt_id", "region_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "txt"))).alias("t"))
    blocks = blocks.select("page_id", "gt_id", F.struct(F.col("region_no").alias("text_block_id"), F.array_join(F.transform("t", lambda x: x["txt"]), "\n").alias("text")).alias("b"))
    articles = blocks.groupBy("page_id", "gt_id").agg(F.sort_array(F.collect_list("b")).alias("text_blocks"))
    pages = articles.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.col("gt_id").alias("article_id"), "text_blocks"))).alias("articles"))
    return pages.select("page_id", F.to_json(F.struct(F.col("page_id").alias("page_file"), "articles")).alias("json"))


def region_json(regions: DataFrame) -> DataFrame:
    """(image, json): an image's regions as closed rings, for regions(image, width, height, pos, class_name, points); a position twice is an error."""
    closed = F.concat("points", F.slice("points", 1, 1))
    ring = F.struct(F.transform(closed, lambda p: p["x"]).alias("x_points"), F.transform(closed, lambda p: p["y"]).alias("y_points"), "class_name")
    rows = regions.groupBy("image", "width", "height").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("string").alias("key"), ring.alias("value"))))).alias("regions"))
    return rows.select("image", F.to_json(F.struct("regions", "height", "width")).alias("json"))


def missing_files(spark: SparkSession, wanted: DataFrame, folder: str) -> DataFrame:
    """The paths of wanted(path) that no file under the folder has."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^file:", "").alias("path"))
    return wanted.select("path").join(there, "path", "left_anti")
