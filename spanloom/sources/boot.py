"""Boot dumps: what two web frameworks say about their own routes when started."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHAIN = "array<struct<position:int,phase:string,name:string,key:string,file:string,line:int,col:int,endLine:int,anonymous:boolean,origin:string,declaredIn:string,inheritedFrom:string>>"
BOOT = f"schema string, service string, routes array<struct<method:string,url:string,prefix:string,routeKey:string,hasSchema:boolean,requestSchema:string,responseSchema:string,chain:{_CHAIN}>>, warnings array<string>"
FASTAPI = (
    "schema string, service string, middleware array<struct<name:string,file:string,line:int>>,"
    " routes array<struct<method:string,url:string,prefix:string,hasSchema:boolean,chain:array<struct<position:int,phase:string,name:string,key:string,file:string,line:int,endLine:int,security:boolean>>>>"
)
ORIGINS = ["scope", "route", "framework", "handler"]


def read_boot(spark: SparkSession, path: str) -> DataFrame:
    """One row per route: service, method, url, prefix, has_schema, route_key, chain.

    A dump without a schema name or with an origin outside ORIGINS fails and names the route.
    """
    dumps = spark.read.schema(BOOT).option("mode", "FAILFAST").json(path, multiLine=True)
    dumps = dumps.withColumn("service", F.when(F.col("schema").isNotNull(), F.col("service")).otherwise(F.raise_error(F.lit("a boot dump names no schema")).cast("string")))
    routes = dumps.select("service", F.explode("routes").alias("r")).select(
        "service", F.upper("r.method").alias("method"), F.col("r.url").alias("url"), F.coalesce("r.prefix", F.lit("")).alias("prefix"), F.coalesce("r.hasSchema", F.lit(False)).alias("has_schema"), F.coalesce("r.routeKey", F.concat_ws(" ", "service", F.upper("r.method"), "r.url")).alias("route_key"), F.col("r.chain").alias("chain")
    )
    sound = F.forall("chain", lambda e: e["origin"].isin(*ORIGINS))
    return routes.withColumn("route_key", F.when(sound, F.col("route_key")).otherwise(F.raise_error(F.concat(F.lit("unknown origin in the chain of "), "route_key")).cast("string")))


def read_fastapi(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from the other framework: handlers stay handlers, all else runs before.

    Application middleware comes first in every chain, inherited from the service.
    """
    dumps = spark.read.schema(FASTAPI).option("mode", "FAILFAST").json(path, multiLine=True)
    rows = dumps.select("service", F.coalesce("middleware", F.array().cast("array<struct<name:string,file:string,line:int>>")).alias("m"), F.explode("routes").alias("r"))
    none = lambda kind: F.lit(None).cast(kind)

    def entry(position, phase, name, key, file, line, end, origin, inherited):
        return F.struct(position.cast("int").alias("position"), phase.alias("phase"), name.alias("name"), key.alias("key"), file.alias("file"), line.cast("int").alias("line"), none("int").alias("col"), end.cast("int").alias("endLine"), name.isNull().alias("anonymous"), origin.alias("origin"), none("string").alias("declaredIn"), inherited.alias("inheritedFrom"))

    middle = F.transform("m", lambda m, i: entry(i, F.lit("onRequest"), m["name"], none("string"), m["file"], m["line"], none("int"), F.lit("framework"), F.col("service")))
    own = F.transform("r.chain", lambda e, i: entry(i + F.size("m"), F.when(e["phase"] == "handler", "handler").otherwise("preHandler"), e["name"], e["key"], e["file"], e["line"], e["endLine"], F.when(e["phase"] == "handler", "handler").otherwise("route"), none("string")))
    return rows.select("service", F.upper("r.method").alias("method"), F.col("r.url").alias("url"), F.coalesce("r.prefix", F.lit("")).alias("prefix"), F.coalesce("r.hasSchema", F.lit(False)).alias("has_schema"), F.concat_ws(" ", "service", F.upper("r.method"), "r.url").alias("route_key"), F.concat(middle, own).alias("chain"))


def expand_chain(routes: DataFrame) -> DataFrame:
    """One row per chain entry; positions are those of the dump, never counted again."""
    return routes.select("service", "route_key", F.explode("chain").alias("e")).select(
        "service", "route_key", "e.position", "e.phase", "e.name", "e.key", "e.origin", F.col("e.inheritedFrom").alias("inherited_from"), "e.file", "e.line", F.col("e.endLine").alias("end_line"), F.concat_ws(":", "e.position", "e.phase").alias("detail")
    )
