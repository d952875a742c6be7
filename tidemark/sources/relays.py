"""Directories of relays: read from several JSON files, overlaid with live probes, and merged by host."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import blank, url_host
from tidemark.sources.feeds import live_probes
from tidemark.sources.tables import exists

#: What a record has once it is read; see `read_directories`.
RECORD = (
    "id string, name string, subtitle string, homeUrl string, signupUrl string, docsUrl string, tags array<string>, bonus string, recommended boolean, registerOpen boolean, "
    "loginMethods array<string>, checkinEnabled boolean, online boolean, latencyMs long, checkedAt string, models array<string>, modelsCount int, modelsNote string, announcement string, mirror string"
)
PROBE = (
    "struct<id:string,online:boolean,error:string,latencyMs:bigint,checkedAt:string,registerOpen:boolean,loginMethods:array<string>,checkinEnabled:boolean,"
    "models:array<struct<name:string>>,modelsSource:string,announcements:array<struct<date:string,text:string>>,mirrors:array<struct<homeUrl:string,online:boolean>>>"
)
#: Taken from the first record of a host that has it.
FILL = ("bonus", "subtitle", "signupUrl", "docsUrl", "mirror", "announcement", "modelsNote", "registerOpen", "loginMethods", "checkinEnabled")
MOST_TAGS, MOST_MODELS, MOST_METHODS, NEWS = 6, 8, 4, 130


@dataclass(frozen=True)
class Directory:
    """A JSON file with an array of records, or an object that has one as `sites` or `stations`; perhaps another with probes."""

    name: str
    path: str
    live: str | None = None


def _whole(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.text(path, wholetext=True) if exists(spark, path) else None


def read_directories(spark: SparkSession, directories: list[Directory]) -> tuple[DataFrame, DataFrame]:
    """(records, meta): the records of all directories with source, rank (of the directory) and pos, overlaid with their probes; meta has a row for each directory.

    A directory that is missing, or is no JSON, gives no record, and says so in
    meta (source, ok, sites, live); missing probes are no probes.
    """
    every, meta = spark.createDataFrame([], RECORD + ", source string, rank int, pos int"), spark.createDataFrame([], "source string, ok boolean, sites long, live long")
    for k, d in enumerate(directories):
        text = _whole(spark, d.path)
        if text is None:
            meta = meta.unionByName(spark.createDataFrame([(d.name, False, 0, 0)], meta.schema))
            continue
        c = F.col("value")
        array = F.when(c.rlike(r"^\s*\["), c).otherwise(F.coalesce(F.get_json_object(c, "$.sites"), F.get_json_object(c, "$.stations")))
        fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in spark.createDataFrame([], RECORD).schema)
        read = text.select(F.from_json(array, f"array<struct<{fields}>>").alias("rows"))
        rows = read.select(F.posexplode("rows").alias("pos", "r")).where("r IS NOT NULL").select("r.*", F.lit(d.name).alias("source"), F.lit(k).alias("rank"), "pos")
        live = _whole(spark, d.live) if d.live else None
        n_live = F.lit(0).cast("long")
        if live is not None:
            probes = live.select(F.explode(live_probes(F.col("value"), PROBE)).alias("p")).select("p.*").where("id IS NOT NULL")
            rows = overlaid(rows, probes)
            meta_live = probes.agg(F.count(F.lit(1)).alias("live"))
        counted = read.agg(F.coalesce(F.max(F.col("rows").isNotNull()), F.lit(False)).alias("ok"), F.coalesce(F.sum(F.size(F.coalesce("rows", F.array().cast(read.schema["rows"].dataType)))), F.lit(0)).alias("sites"))
        counted = counted.join(F.broadcast(meta_live)) if live is not None else counted.withColumn("live", n_live)  # rows of one each
        meta = meta.unionByName(counted.select(F.lit(d.name).alias("source"), "ok", F.col("sites").cast("long").alias("sites"), "live"))
        every = every.unionByName(rows.select(*every.columns))
    return every, meta


def overlaid(records: DataFrame, probes: DataFrame) -> DataFrame:
    """Records with what their probe (by id; the last of several) saw laid over them; what it did not see stays."""
    last = probes.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct(*(c for c in probes.columns)), F.coalesce("checkedAt", F.lit(""))).alias("p"))
    met = records.join(last, F.col("id") == F.col("_id"), "left")
    p = lambda c: F.col(f"p.{c}")
    names = F.filter(F.transform(p("models"), lambda m: m["name"]), lambda x: blank(x) != "")
    has = F.coalesce(F.size(names) > 0, F.lit(False))
    news = F.get(F.filter(p("announcements"), lambda a: blank(a["text"]) != ""), F.lit(0))["text"]
    mirror = F.get(F.filter(p("mirrors"), lambda m: (blank(m["homeUrl"]) != "") & F.coalesce(m["online"], F.lit(True))), F.lit(0))["homeUrl"]
    short = F.when(F.length(news) > NEWS, F.concat(F.substring(news, 1, NEWS - 1), F.lit("…"))).otherwise(news)
    return met.withColumns({
        "online": F.coalesce(p("online"), F.when(p("error").isNotNull(), False), F.col("online")), "latencyMs": F.coalesce(p("latencyMs"), F.col("latencyMs")),
        "checkedAt": F.coalesce(p("checkedAt"), F.col("checkedAt")), "registerOpen": F.coalesce(p("registerOpen"), F.col("registerOpen")),
        "loginMethods": F.when(F.size(p("loginMethods")) > 0, F.slice(p("loginMethods"), 1, MOST_METHODS)).otherwise(F.col("loginMethods")),
        "checkinEnabled": F.coalesce(p("checkinEnabled"), F.col("checkinEnabled")), "models": F.when(has, F.slice(names, 1, MOST_MODELS)).otherwise(F.col("models")),
        "modelsCount": F.when(has, F.size(names)).otherwise(F.col("modelsCount")), "modelsNote": F.when(~has & (p("modelsSource") == "login-required"), "models are shown after login").otherwise(F.col("modelsNote")),
        "announcement": F.coalesce(short, F.col("announcement")), "mirror": F.coalesce(mirror, F.col("mirror")),
    }).select(*records.columns)


def merged_relays(records: DataFrame) -> DataFrame:
    """One record for each host (for each id, where there is no host): the first one, with what it lacks from later ones.

    Records go by (rank, pos). A host that is not known to be online takes the first
    record that says so, with its time. Tags are united in order, MOST_TAGS of them
    where records meet; `sources` are all records' directories in order. Each column
    is a minimum over places, so that rows combine before the shuffle.
    """
    host = F.regexp_replace(url_host(F.col("homeUrl")), r"^www\.", "")
    at = F.struct("rank", "pos", "id")
    placed = records.withColumn("host", F.when(host != "", host).otherwise(F.col("id"))).withColumn("_at", at).where("host IS NOT NULL")

    def first(c: Column, where: Column) -> Column:
        return F.min_by(c, F.when(where, F.col("_at")))

    given = lambda c: F.col(c).isNotNull() & (blank(F.col(c)) != "") if records.schema[c].dataType.simpleString() == "string" else F.col(c).isNotNull()
    up = F.col("online") == F.lit(True)
    out = placed.groupBy("host").agg(
        F.min_by(F.struct("id", "name", "homeUrl", "recommended", "online", "latencyMs", "checkedAt", "tags"), "_at").alias("b"), *(first(F.col(c), given(c)).alias(c) for c in FILL),
        first(F.struct("models", "modelsCount"), F.col("models").isNotNull()).alias("m"), first(F.struct("checkedAt", "latencyMs"), up).alias("u"), F.count_if(up).alias("_up"),
        F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_set(F.struct("_at", "source"))), lambda x: x["source"]).alias("sources"),
    )
    each = placed.select("host", "_at", F.posexplode("tags").alias("k", "tag")).groupBy("host", "tag").agg(F.min(F.struct("_at", "k")).alias("first"))
    tags = each.groupBy(F.col("host").alias("_host")).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))), lambda x: x["tag"]).alias("_tags"))
    rises = (F.col("_up") > 0) & ~F.coalesce(F.col("b.online"), F.lit(False))
    none = F.array().cast("array<string>")
    return out.join(tags, F.col("host") == F.col("_host"), "left").select(
        "host", "b.id", "b.name", "b.homeUrl", "b.recommended", F.when(rises, True).otherwise(F.col("b.online")).alias("online"),
        F.when(rises, F.coalesce("b.latencyMs", "u.latencyMs")).otherwise(F.col("b.latencyMs")).alias("latencyMs"), F.when(rises, F.coalesce("u.checkedAt", "b.checkedAt")).otherwise(F.col("b.checkedAt")).alias("checkedAt"),
        *FILL, "m.models", "m.modelsCount", F.when(F.col("n") > 1, F.slice(F.coalesce("_tags", none), 1, MOST_TAGS)).otherwise(F.coalesce("_tags", none)).alias("tags"), "sources",
    )


def relay_order() -> list[Column]:
    """Recommended ones first, then those online, then by name."""
    return [F.desc(F.coalesce("recommended", F.lit(False))), F.desc(F.coalesce("online", F.lit(False))), F.collate(F.col("name"), "zh")]
