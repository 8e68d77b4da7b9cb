"""The library's tables as views over the given ones, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.ordered import number_rows
from emberline.operators.temporal import segment_on_resize
from emberline.operators.tiles import bytes_of

CLASS_NAMES = ["Fire", "None", "SmokeOnly"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_of(ts: str) -> Column:
    """Hours since 1970 of a zone-less timestamp."""
    return F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)


def micros_of(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's time zone."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a frame log: one camera per user, frames in time order, numbered by hour buckets."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    ev = number_rows(ev, ["user_id"], ["ts", "event_id"], hour_of("ts"), "frame_idx")
    u = F.col("user_id")
    label = (
        F.when(F.col("event_type") == "error", "Fire")
        .when(F.col("event_type") == "purchase", "SmokeOnly")
        .when(F.col("event_type") == "click", "None")
        .when(F.col("event_type") == "view", "skipped")
    )
    return ev.select(
        u.alias("channel"),
        F.concat(F.lit("ds"), (u % 4).cast("string")).alias("dataset"),
        F.concat(F.when(u % 3 == 0, "nofire_").otherwise("fire_"), u.cast("string")).alias("video"),
        "frame_idx",
        (F.col("value") / F.lit(1000.0)).alias("elapsed_time"),
        label.alias("pred_label"),
        "ts",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


FRAMES = """frames AS (
  SELECT user_id AS channel, 'ds' || (user_id % 4) AS dataset,
         CASE WHEN user_id % 3 = 0 THEN 'nofire_' ELSE 'fire_' END || user_id AS video,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_idx,
         value / CAST(1000.0 AS DOUBLE) AS elapsed_time,
         CASE event_type WHEN 'error' THEN 'Fire' WHEN 'purchase' THEN 'SmokeOnly'
              WHEN 'click' THEN 'None' WHEN 'view' THEN 'skipped' END AS pred_label,
         ts, CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events)"""

# Label tests used by many of the SQL forms.
POS = "regexp_matches(lower(coalesce(pred_label, 'None')), 'fire|smoke')"
DET = "lower(coalesce(pred_label, 'None')) <> 'none'"
BINARY = f"CASE WHEN {POS} THEN 'positive' ELSE 'negative' END"
TRUTH = "CASE WHEN contains(video, 'nofire') THEN 'negative' ELSE 'positive' END"


def _numbered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    bucket = F.floor(F.col("vec_id") / F.lit(1 << 16))
    out = number_rows(emb, ["label"], ["vec_id"], bucket, "frame_idx")
    return out.select(
        F.concat(F.lit("emb_"), F.col("label").cast("string")).alias("video"), "frame_idx", "vec_id", "label", "embedding"
    )


def _byte(v: Column) -> Column:
    return F.floor((v.cast("double") + 1) * 128).cast("int")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 gray frame of the camera named by its label."""
    emb = _numbered_vectors(spark, sf_dir).select("video", "frame_idx", F.posexplode("embedding").alias("p", "v"))
    p = F.col("p")
    return emb.select(
        "video",
        "frame_idx",
        F.floor(p / F.lit(8)).cast("int").alias("y"),
        (p % 8).cast("int").alias("x"),
        _byte(F.col("v")).alias("gray"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames packed: one row of 64 bytes each."""
    emb = _numbered_vectors(spark, sf_dir)
    sizes = {"ty": 0, "tx": 0, "h": 8, "w": 8, "channels": 1}
    return emb.select(
        "video",
        "frame_idx",
        *[F.lit(v).alias(n) for n, v in sizes.items()],
        bytes_of(F.transform("embedding", _byte)).alias("data"),
    )


def _colour(p: Column, channel: int) -> Column:
    """Channel of a pixel of an 8 x 8 colour frame: the vector's value there, a third of the vector on, and two thirds on."""
    return _byte(F.get("embedding", (p + 21 * channel) % 64))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 colour image of blue-green-red bytes."""
    emb = _numbered_vectors(spark, sf_dir)
    sizes = {"height": 8, "width": 8, "channels": 3}
    places = F.sequence(F.lit(0), F.lit(191))
    values = F.transform(places, lambda i: _colour(F.floor(i / 3).cast("int"), i % 3))
    return emb.select("video", "frame_idx", *[F.lit(v).alias(n) for n, v in sizes.items()], bytes_of(values).alias("data"))


def cells_bgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same colour frames, a row for each pixel."""
    emb = _numbered_vectors(spark, sf_dir)
    p = F.col("p")
    emb = emb.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return emb.select(
        "video",
        "frame_idx",
        F.floor(p / F.lit(8)).cast("int").alias("y"),
        (p % 8).cast("int").alias("x"),
        *[_colour(p, i).alias(c) for i, c in enumerate("bgr")],
    )


def resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a frame of 8 x 8 pixels or of 4 rows of 16, changing every seventh frame, with its ``segment``."""
    emb = _numbered_vectors(spark, sf_dir)
    wide = F.floor(F.col("frame_idx") / 7) % 2 == 1
    return segment_on_resize(emb.withColumns({"height": F.when(wide, 4).otherwise(8), "width": F.when(wide, 16).otherwise(8)}))


def resized_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resized(spark, sf_dir).select("video", "frame_idx", "segment", "width", F.posexplode("embedding").alias("p", "v"))
    return rows.select(
        "video",
        "frame_idx",
        "segment",
        F.floor(F.col("p") / F.col("width")).cast("int").alias("y"),
        (F.col("p") % F.col("width")).cast("int").alias("x"),
        _byte(F.col("v")).alias("gray"),
    )


def resized_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resized(spark, sf_dir).select(
        "video",
        "frame_idx",
        "segment",
        *[F.lit(0).alias(n) for n in ("ty", "tx")],
        F.col("height").alias("h"),
        F.col("width").alias("w"),
        F.lit(1).alias("channels"),
        bytes_of(F.transform("embedding", _byte)).alias("data"),
    )


EMB = """emb AS (
  SELECT 'emb_' || label AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame_idx,
         vec_id, label, embedding FROM embeddings)"""
CELLS = (
    EMB
    + """, cells AS (
  SELECT video, frame_idx, CAST((p - 1) // 8 AS INTEGER) AS y, CAST((p - 1) % 8 AS INTEGER) AS x,
         CAST(floor((CAST(embedding[p] AS DOUBLE) + 1) * 128) AS INTEGER) AS gray
  FROM (SELECT video, frame_idx, embedding, unnest(range(1, 65)) AS p FROM emb))"""
)
BGR = (
    EMB
    + """, bgr AS (
  SELECT video, frame_idx, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x,
         CAST(floor((CAST(embedding[p + 1] AS DOUBLE) + 1) * 128) AS INTEGER) AS b,
         CAST(floor((CAST(embedding[(p + 21) % 64 + 1] AS DOUBLE) + 1) * 128) AS INTEGER) AS g,
         CAST(floor((CAST(embedding[(p + 42) % 64 + 1] AS DOUBLE) + 1) * 128) AS INTEGER) AS r
  FROM (SELECT video, frame_idx, embedding, unnest(range(0, 64)) AS p FROM emb))"""
)
DIFFS = (
    CELLS
    + """, diffs AS (
  SELECT video, frame_idx, y, x, gray,
         abs(gray - lag(gray) OVER (PARTITION BY video, y, x ORDER BY frame_idx)) AS diff FROM cells)"""
)


RESIZED = (
    EMB
    + """, sized AS (SELECT *, CASE WHEN frame_idx // 7 % 2 = 1 THEN 16 ELSE 8 END AS width FROM emb),
  changed AS (SELECT *, width <> lag(width, 1, width) OVER (PARTITION BY video ORDER BY frame_idx) AS new FROM sized),
  numbered AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY video ORDER BY frame_idx) AS segment FROM changed),
  cells AS (SELECT video, frame_idx, segment, CAST((p - 1) // width AS INTEGER) AS y, CAST((p - 1) % width AS INTEGER) AS x,
    CAST(floor((CAST(embedding[p] AS DOUBLE) + 1) * 128) AS INTEGER) AS gray FROM (SELECT *, unnest(range(1, 65)) AS p FROM numbered)),
  diffs AS (SELECT video, frame_idx, segment, y, x, gray,
    abs(gray - lag(gray) OVER (PARTITION BY video, segment, y, x ORDER BY frame_idx)) AS diff FROM cells)"""
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three class scores per vector, each from every third of its 64 values, with a target class."""
    emb = table(spark, sf_dir, "embeddings")

    def score(k: int) -> Column:
        third = F.filter("embedding", lambda v, i: i % 3 == k)
        return F.aggregate(third, F.lit(0).cast("long"), lambda s, v: s + _byte(v) - 128) / F.lit(64.0)

    return emb.select(
        "vec_id",
        F.array(*[score(k) for k in range(3)]).alias("logits"),
        F.array(*[F.lit(c) for c in CLASS_NAMES]).alias("class_names"),
        (F.col("label") % 3).cast("int").alias("target"),
    )


SCORES = "scores AS (SELECT vec_id, {}, label % 3 AS target FROM embeddings)".format(
    ", ".join(
        f"list_sum(list_transform(list_filter(embedding, lambda v, i: (i - 1) % 3 = {k}), lambda v: floor((CAST(v AS DOUBLE) + 1) * 128) - 128)) / 64.0::DOUBLE AS {n}"
        for k, n in enumerate("abc")
    )
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked points: the vector's values in pairs."""
    emb = table(spark, sf_dir, "embeddings").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return emb.select(
        "vec_id",
        *[F.get("embedding", F.col("i") * 2 + j).cast("double").alias(n) for j, n in enumerate(("dx", "dy"))],
    )


POINTS = """points AS (
  SELECT vec_id, CAST(embedding[2 * i + 1] AS DOUBLE) AS dx, CAST(embedding[2 * i + 2] AS DOUBLE) AS dy
  FROM (SELECT vec_id, embedding, unnest(range(0, 32)) AS i FROM embeddings))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as timed steps; no discount means the call never ended."""
    li = table(spark, sf_dir, "lineitem")
    end = F.col("l_quantity") + F.col("l_tax") + F.col("l_discount")
    return li.select(
        F.col("l_returnflag").alias("ctx"),
        F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("step"),
        F.col("l_quantity").alias("t_start"),
        F.when(F.col("l_discount") != 0, end).alias("t_end"),
    )


SPANS = """spans AS (
  SELECT l_returnflag AS ctx, 's' || l_linenumber AS step, l_quantity AS t_start,
         CASE WHEN l_discount <> 0 THEN l_quantity + l_tax + l_discount END AS t_end FROM lineitem)"""


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as experiment runs with a name, machine, dataset, method and time stamp."""
    o = table(spark, sf_dir, "orders")
    methods = F.array(*[F.lit(m) for m in ("no_temp", "temp_tpt", "temp_stabilize", "no_temp", "temp_tpt")])
    method = F.element_at(methods, F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.select(
        "o_orderkey",
        F.concat(
            F.col("o_orderstatus"),
            F.lit("__ds_D"),
            (F.col("o_custkey") % 4).cast("string"),
            F.lit("__mt_"),
            method,
            F.lit("__"),
            F.date_format("o_orderdate", "yyyyMMdd"),
            F.lit(".000000"),
        ).alias("run"),
    )


RUNS = """runs AS (
  SELECT o_orderkey, o_orderstatus AS machine, 'D' || (o_custkey % 4) AS dataset,
         CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'no_temp' WHEN '2' THEN 'temp_tpt'
              WHEN '3' THEN 'temp_stabilize' WHEN '4' THEN 'no_temp' ELSE 'temp_tpt' END AS method,
         strftime(o_orderdate, '%Y%m%d') || '.000000' AS stamp
  FROM orders), named AS (
  SELECT *, machine || '__ds_' || dataset || '__mt_' || method || '__' || stamp AS run FROM runs)"""


def video_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a video inventory."""
    return table(spark, sf_dir, "pages").select(
        F.col("url").alias("video_path"),
        F.length("html").cast("int").alias("frame_count"),
        (1.0 + F.col("page_id") % 30).cast("double").alias("fps"),
        F.concat(F.lit("site"), (F.col("page_id") % 3).cast("string")).alias("dataset"),
    )


META = """meta AS (
  SELECT url AS video_path, CAST(length(html) AS INTEGER) AS frame_count,
         CAST(1 + page_id % 30 AS DOUBLE) AS fps, 'site' || (page_id % 3) AS dataset FROM pages)"""
