"""Account documents, settings and keyed results as tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
RECT = "struct<x:int,y:int,w:int,h:int>"
SOURCE = "struct<id:string,path:string,sha256:string,filename:string,width:int,height:int,source_index:int,mtime:double,status:string,error_message:string,manual_category:string>"
ASSET = f"struct<id:string,source_id:string,category:string,crop_rect:{RECT},detector:string,confidence:double,locked:boolean,partial:boolean,empty:boolean,duplicate:boolean,manual_override:boolean,manual_rejected:boolean,duplicate_of:string>"
SESSION = f"version int, account_id string, uid string, uid_manual string, uid_confidence double, sources map<string,{SOURCE}>, assets array<{ASSET}>"


def sessions(spark: SparkSession, path: str, version: int = VERSION) -> DataFrame:
    """The account documents under ``path``; those of another version are an error row, not a failure."""
    rows = spark.read.schema(SESSION).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return rows.withColumn("error", F.when(~F.col("version").eqNullSafe(F.lit(version)), "unsupported version"))


def sources_of(df: DataFrame) -> DataFrame:
    return df.where("error is null").select("account_id", F.explode(F.map_values("sources")).alias("s")).select("account_id", "s.*")


def assets_of(df: DataFrame) -> DataFrame:
    return df.where("error is null").select("account_id", F.posexplode("assets").alias("order", "a")).select("account_id", "order", "a.*")


def save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces the tables of the accounts (or other keys) in ``df`` and leaves the others."""
    out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(*by) if by else out).parquet(path)


def save_plan(placements: DataFrame, path: str) -> None:
    placements.write.mode("overwrite").json(path)


def missing(tasks: DataFrame, results: DataFrame, key: str = "cache_key") -> DataFrame:
    """Tasks without a kept result."""
    return tasks.join(results.select(key), key, "left_anti")


def reused(tasks: DataFrame, results: DataFrame, key: str = "cache_key") -> DataFrame:
    return tasks.join(results, key)


def stored(results: DataFrame, new: DataFrame, key: str = "cache_key") -> DataFrame:
    """Kept results after ``new`` ones were put over them."""
    return results.join(new.select(key), key, "left_anti").unionByName(new)


def sound(results: DataFrame, content: str = "content", digest: str = "sha256") -> DataFrame:
    """Kept results whose content still has its digest; a corrupt one counts as missing and is computed again."""
    return results.where(F.sha2(F.col(content), 256) == F.col(digest))


def granted(files: DataFrame, root: str, most: int = 20 * 1024 * 1024) -> DataFrame:
    """Files (path, length, modified) that an import of folder ``root`` may read: id, name, relative path and an error for files above ``most`` bytes.

    Files outside ``root`` and other kinds than images are left out. The id does not tell the path.
    """
    from quiltframe.sources.catalog import EXTENSIONS

    base = root.rstrip("/")
    inside = F.col("path").startswith(base + "/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    rows = files.where(inside & F.lower(F.substring_index("path", ".", -1)).isin(*EXTENSIONS))
    relative = F.concat(F.lit(base.rsplit("/", 1)[-1]), F.substring(F.col("path"), len(base) + 1, 1 << 30))
    return rows.select(
        F.substring(F.sha2(F.concat(F.lit("grant:"), "path"), 256), 1, 24).alias("id"), F.substring_index("path", "/", -1).alias("name"), relative.alias("relative_path"),
        F.col("modified"), F.when(F.col("length") > most, "too large").alias("error"),
    )


def forms(spark: SparkSession, path: str) -> DataFrame:
    """Layout forms of version 1 that have an id; of those with one id the last file's."""
    rows = spark.read.schema("version int, id string, canvas_width int, zone_ratios map<string,double>").option("multiLine", "true").json(path)
    rows = rows.withColumn("file", F.input_file_name()).where("version = 1 and id is not null")
    return rows.groupBy("id").agg(F.max_by(F.struct("canvas_width", "zone_ratios"), "file").alias("f")).select("id", "f.*")


#: Bounds of settings that aren't shares, and the words that others may be.
BOUNDS = {"near_distance": (0, 64), "ambiguity": (0.0, 0.5), "mae": (0.1, 100.0), "workers": (1, 8), "cache_size": (16, 10_000), "scan_size": (400, 4000)}
WORDS = {"device": ("auto", "gpu", "cpu"), "colour": ("off", "preview", "photoshop")}


@dataclass(frozen=True)
class Settings:
    """Thresholds; values out of bounds are an error."""

    accept: float = 0.85
    review: float = 0.55
    ambiguity: float = 0.1
    ocr_accept: float = 0.8
    iou: float = 0.7
    near_distance: int = 10

    detector: float = 0.6
    lock: float = 0.5
    empty: float = 0.35
    ocr_review: float = 0.5
    mae: float = 12.0
    workers: int = 2
    cache_size: int = 512
    scan_size: int = 1600
    device: str = "auto"
    colour: str = "off"

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name in WORDS:
                if v.lower() not in WORDS[f.name]:
                    raise ValueError(f"{f.name} must be one of {WORDS[f.name]}")
                continue
            low, high = BOUNDS.get(f.name, (0.0, 1.0))
            if not low <= v <= high:
                raise ValueError(f"{f.name} must lie in {low} to {high}")
        if self.review > self.accept or self.ocr_review > self.ocr_accept:
            raise ValueError("what needs a review must not be above what is accepted")

    @classmethod
    def load(cls, text: str) -> Settings:
        """From JSON; unknown names are an error, missing ones keep their defaults."""
        return cls(**json.loads(text))

    def save(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)
