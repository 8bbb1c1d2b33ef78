"""The operators' input tables, derived from the given tables by Spark.

Sources stand for pools, suppliers for files with many pages, nations for graphs, users for
documents with a log. Every mapping keeps all rows of its table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolwright.operators.ordering import enough_parts, running
from poolwright.session import run_folder

SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long"}
LINE = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def pool_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by source: read, failed, pending and never-read files, and text documents."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    quality, lang = F.col("quality"), F.col("lang")
    kind = F.when(quality.isNotNull() | lang.isin("fr", "es"), "file").otherwise("text")
    state = (
        F.when(quality == 1, "ready").when(quality == 0, "failed").when(lang == "fr", "pending").otherwise("")
    )
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("source").alias("pool_id"),
        F.col("doc_id").alias("seq"),
        "doc_id",
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        kind.alias("kind"),
        state.alias("state"),
        F.lit("text/plain; charset=utf-8").alias("mime"),
        (F.lit(1_700_000_000) + F.col("n_chars") % 1000).alias("created"),
        "text",
    )


def pool_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select(F.col("source").alias("pool_id"), "doc_id", "text")


def pool_images(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of every document: none, one or two, by its length."""
    docs = table(spark, folder, "documents")
    n = (F.col("n_chars") % 3).cast("int")
    idx = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    size = F.col("n_chars") % 400 + 30 * F.col("idx") + 1
    return docs.select("doc_id", "n_chars", "text", idx.alias("idx")).select(
        "doc_id", "idx", (F.col("idx") * 2).alias("page"), F.repeat(F.lit("x"), size.cast("int")).cast("binary").alias("data")
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items, each asked in one pool."""
    pool = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), pool.alias("pool_id"), "text"
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One question about every document, the questions taken in turn."""
    n = max(1, table(spark, folder, "benchmark").count())
    docs = table(spark, folder, "documents")
    return docs.select((F.col("doc_id") % n).alias("question_id"), "doc_id")


def part_refs(spark: SparkSession, folder: str) -> DataFrame:
    """References known for documents of good quality, and for the pictures of toxic ones."""
    labels = table(spark, folder, "labels")
    name = F.concat(F.lit("ref-"), F.col("doc_id").cast("string"))
    texts = labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0)).select(
        "doc_id", F.lit("text").alias("part"), F.lit(-1).alias("idx"), name.alias("ref")
    )
    pictures = labels.filter(F.col("toxic") == 1).select(
        "doc_id", F.lit("image").alias("part"), F.lit(0).alias("idx"), name.alias("ref")
    )
    return texts.unionByName(pictures)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def extract_events(events: DataFrame) -> DataFrame:
    """Read events of documents, from the event table or stream."""
    kind = F.col("event_type")
    state = (
        F.when(kind == "signup", "pending")
        .when(kind == "view", "reading")
        .when(kind.isin("click", "purchase"), "ready")
        .otherwise("failed")
    )
    ready = state == "ready"
    k = _k()
    return events.select(
        F.col("user_id").alias("doc_id"),
        F.col("ts").cast("timestamp").alias("t"),
        "event_id",
        state.alias("state"),
        F.when(ready, F.repeat(F.lit("w"), k)).alias("text"),
        F.when(ready, F.when(kind == "click", "text-layer").otherwise("ai")).alias("source"),
        F.when(ready, F.concat(F.lit("m"), (k % 5).cast("string"))).alias("model"),
        F.when(ready, F.concat(F.lit("e"), (k % 3).cast("string"))).alias("engine"),
        F.when(state == "failed", F.concat(F.lit("error "), k.cast("string"))).alias("error"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"),
        (k % 2 == 0).alias("text_layer"),
        (k % 7).alias("done"),
        (k % 10).alias("total"),
        F.concat(F.lit("page "), k.cast("string")).alias("label"),
        F.when(k % 3 == 0, "compressing").otherwise("reading").alias("phase"),
    )


def graph_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    k = _k()
    return events.select(
        F.col("user_id").alias("graph_id"),
        F.col("ts").cast("timestamp").alias("t"),
        "event_id",
        F.when(kind == "click", "ok")
        .when(kind == "signup", "empty")
        .when(kind == "error", "failed")
        .when(kind == "view", "manual")
        .otherwise("restore")
        .alias("kind"),
        F.concat(F.lit("graph "), F.col("event_id").cast("string")).alias("graph"),
        F.concat(F.lit("key "), k.cast("string")).alias("source_key"),
        F.concat(F.lit("note "), k.cast("string")).alias("note"),
        F.concat(F.lit("m"), (k % 5).cast("string")).alias("model"),
        F.concat(F.lit("e"), (k % 3).cast("string")).alias("engine"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"),
    )


def attempts(events: DataFrame) -> DataFrame:
    """Reads of sections: a user's document, the section by the event's number."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("doc_id"),
        (_k() % 20).alias("idx"),
        F.col("ts").cast("timestamp").alias("t"),
        "event_id",
        F.when(kind.isin("click", "purchase"), "read")
        .when(kind == "view", "timeout")
        .when(kind == "error", "error")
        .otherwise("outage")
        .alias("outcome"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as the pages of supplier files: doc_id, page, and the line itself."""
    items = table(spark, folder, "lineitem").withColumnRenamed("l_suppkey", "doc_id")
    return running(items, ["doc_id"], LINE, "page")


def pages_of_files(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).select("doc_id", "page", F.col("l_quantity").cast("long").alias("bytes"))


def image_refs(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).select(
        "doc_id",
        F.floor((F.col("page") - 1) / 4 + 1).alias("page"),
        ((F.col("page") - 1) % 4).alias("place"),
        F.col("l_partkey").alias("object"),
    )


def section_results(spark: SparkSession, folder: str) -> DataFrame:
    """What was read of each page: text from the part's name, failures from the line's flags."""
    names = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_size")
    flag, status, size = F.col("l_returnflag"), F.col("l_linestatus"), F.col("p_size")
    read = (flag == "N") | (size > 25)
    return lines(spark, folder).join(names, "l_partkey").select(
        "doc_id",
        (F.col("page") - 1).alias("idx"),
        F.concat(F.lit("page "), F.col("page").cast("string")).alias("label"),
        F.when(status == "O", "image").otherwise("").alias("track"),
        F.col("page").cast("int").alias("page"),
        F.when(read, F.when(size > 45, " \n").otherwise(F.concat("p_name", F.lit("\n")))).alias("text"),
        F.when(size == 1, "an embedded image could not be read (an unsupported image format)").alias("note"),
        (size == 2).alias("too_big"),
        F.when(~read, F.when(flag == "R", "too slow").otherwise("unreadable")).alias("err"),
        F.when(read & (size <= 45), F.col("p_brand")).alias("model"),
        F.when(read & (size <= 45), F.lit("engine")).alias("engine"),
    )


def section_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome of each page, with an interruption where a returned line is still open and cheap."""
    flag = F.col("l_returnflag")
    broken = (flag == "R") & (F.col("l_quantity") == 1)
    return lines(spark, folder).select(
        "doc_id",
        (F.col("page") - 1).alias("idx"),
        F.when(broken, "interrupted").when(flag == "A", "error").when(flag == "R", "too_slow").otherwise("read").alias("outcome"),
        F.when(F.col("l_linestatus") == "O", "outage").otherwise("cancelled").alias("cause"),
        (flag == "N").alias("legible"),
    )


def supplier_plans(spark: SparkSession, folder: str) -> DataFrame:
    """How many sections each supplier's file has, and whether it has a text of its own."""
    counts = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    who = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_acctbal", "s_nationkey")
    return who.join(counts, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0)).alias("total"),
        (F.col("s_acctbal") > 5000).alias("has_text"),
        (F.col("s_nationkey") % 2 == 0).alias("has_ai"),
    )


def graph_of_supplier(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("graph_id"), "s_suppkey", "s_name", "s_acctbal"
    )


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """A nation's suppliers, then the parts its suppliers ship."""
    sup = graph_of_supplier(spark, folder)
    parts = table(spark, folder, "part")
    shipped = (
        table(spark, folder, "lineitem").select("l_suppkey", "l_partkey")
        .join(sup.select("graph_id", F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")
        .select("graph_id", "l_partkey").distinct()
    )
    a = sup.select(
        "graph_id",
        F.col("s_suppkey").alias("ord"),
        F.concat(F.lit(" s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("name"),
        F.lit("S").alias("symbol"),
        F.col("s_acctbal").alias("x"),
        (F.col("s_acctbal") * 4).alias("y"),
    )
    b = shipped.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "graph_id",
        (F.col("p_partkey") + 1_000_000).alias("ord"),
        # A tenth of the ids is missing and another tenth shared, so both rules bind.
        F.when(F.col("p_partkey") % 10 == 0, "")
        .when(F.col("p_partkey") % 10 == 1, "p1")
        .otherwise(F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
        .alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("symbol"),
        F.when(F.col("p_size") == 7, F.lit("NaN").cast("double")).otherwise(F.col("p_retailprice") * 15).alias("x"),
        (F.col("p_size") - 5.0).alias("y"),
    )
    return a.unionByName(b)


def graph_ports(nodes: DataFrame) -> DataFrame:
    """Four ports on every node, one of them listed twice."""
    ids = F.array(*[F.lit(i) for i in ("1", "2", "2", "3", "4")])
    return nodes.select("graph_id", F.col("ord").alias("node_ord"), F.posexplode(ids).alias("ord", "id")).withColumn(
        "name", F.concat(F.lit("Port "), F.col("id"))
    )


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    sup = graph_of_supplier(spark, folder).select("graph_id", F.col("s_suppkey").alias("l_suppkey"))
    items = table(spark, folder, "lineitem").join(sup, "l_suppkey")
    with enough_parts(spark, items.count()):
        placed = running(items, ["graph_id"], ["l_shipdate", "l_suppkey", *LINE[:-1]], "ord")
    port = F.col("l_linenumber").cast("string")
    return placed.select(
        "graph_id",
        "ord",
        F.when(F.col("ord") % 3 == 0, "").otherwise(F.concat(F.lit("e"), (F.col("l_orderkey") % 500).cast("string"))).alias("id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("from_node"),
        port.alias("from_port"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to_node"),
        port.alias("to_port"),
        F.col("l_returnflag").alias("label"),
    )


def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One answer per part: a small graph in JSON, with prose around it or a fault in it."""
    p = table(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    node = F.struct(
        F.concat(F.lit("n"), key).alias("id"),
        F.col("p_name").alias("name"),
        F.lit("P").alias("symbol"),
        F.col("p_retailprice").alias("x"),
        F.array(F.struct(F.lit("a").alias("id"), F.lit("In").alias("name")), F.struct(F.lit("b").alias("id"), F.lit("Out").alias("name"))).alias("ports"),
    )
    other = F.struct(
        F.lit("hub").alias("id"), F.lit("Hub").alias("name"), F.lit("H").alias("symbol"), F.lit(1.5).alias("x"),
        F.array(F.struct(F.lit("c").alias("id"), F.lit("Hub in").alias("name"))).alias("ports"),
    )
    edge = F.struct(
        F.concat(F.lit("n"), key).alias("from"), F.lit("b").alias("fromPort"), F.lit("hub").alias("to"), F.lit("c").alias("toPort"),
        F.col("p_brand").alias("label"),
    )
    nodes, edges = F.to_json(F.array(node, other)), F.to_json(F.array(edge))
    case = F.col("p_partkey") % 6
    text = (
        F.when(case == 0, F.concat(F.lit('{"nodes":'), nodes, F.lit(',"edges":'), edges, F.lit(',"note":"all"}')))
        .when(case == 1, F.concat(F.lit('Here it is:\n```{"nodes":'), nodes, F.lit(',"edges":{"a":1},"note":5}```')))
        .when(case == 2, F.concat(F.lit('{"nodes":"none","edges":'), edges, F.lit("} done")))
        .when(case == 3, F.concat(F.lit('{"nodes":'), nodes))
        .when(case == 4, F.lit("no answer"))
        .otherwise(F.lit('} {"nodes":[],"edges":[],"note":"nothing found"} .'))
    )
    return p.select(F.col("p_partkey").alias("graph_id"), text.alias("output"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    return c.select(
        F.col("conv_id").alias("owner"),
        "turn",
        "role",
        "text",
        F.when(F.col("role") == "assistant", F.concat(F.lit(" model "), F.col("conv_id").cast("string"))).alias("model"),
        F.when(F.col("role") == "assistant", "engine").alias("engine"),
        F.when(F.col("turn") % 2 == 0, F.lit(0)).otherwise(F.lit(1_700_000_000) + F.col("turn")).alias("created"),
    )


def _head(number: Column) -> Column:
    """The leading bytes of a kind of file, by turns."""
    case = number % 6
    return (
        F.when(case == 1, F.unhex(F.lit("89504E470D0A1A0A")))
        .when(case == 2, F.unhex(F.lit("255044462D")))
        .when(case == 3, F.unhex(F.lit("FFD8FF")))
        .when(case == 4, F.unhex(F.lit("474946383961")))
        .when(case == 5, F.unhex(F.lit("0000")))
        .otherwise(F.unhex(F.lit("")))
    )


def stored_files(spark: SparkSession, folder: str) -> str:
    """Write the pages of each batch of 25 as one file and return the folder: batch=<n>/<name>.txt.

    A file starts with the leading bytes of a kind of file; its pages follow in order, one line end behind each.
    """
    path = f"{run_folder(spark)}/files-{uuid.uuid4().hex}"
    pages = table(spark, folder, "pages").select(F.floor(F.col("page_id") / 25).alias("batch"), "page_id", F.coalesce("html", F.lit("")).alias("html"))
    batches = pages.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("page_id", "html"))).alias("_pages"))
    text = F.concat(_head(F.col("batch")).cast("string"), F.array_join("_pages.html", "\n"))
    batches.select("batch", text.alias("value")).write.partitionBy("batch").text(path)
    return path


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as uploaded files, with the leading bytes of every kind of file in turn."""
    p = table(spark, folder, "pages")
    data = F.when(F.col("page_id") % 17 == 3, F.unhex(F.lit(""))).otherwise(F.concat(_head(F.col("page_id")), F.encode("html", "UTF-8")))
    ending = F.element_at(F.array(*[F.lit(e) for e in (".md", ".CSV", ".Markdown", "")]), (F.col("page_id") % 4 + 1).cast("int"))
    return p.select(
        F.floor(F.col("page_id") / 25).alias("batch"),
        F.col("page_id").alias("ord"),
        F.concat(F.lit(" "), F.regexp_replace("url", "\\?", "\x07"), ending).alias("name"),
        data.alias("data"),
    ).withColumn("size", F.octet_length("data"))
