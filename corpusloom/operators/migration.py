"""Migration of a sealed store: tables whose texts are AES-256-GCM ciphertexts become plain tables.

Tables are written one after another, as later ones depend on earlier ones: chapters give the hashes that
facts, routes and statuses get, runs decide which parts come along.  Each table is one job that opens, counts
(``observe``) and writes; a row that can't be opened is kept with an empty text and a warning beside it.
Counts are written last: a folder without them isn't a finished migration, and isn't read.

The key is a literal of the plan.  Spark shows plans in its user interface and event logs, so run a migration
with ``spark.sql.redaction.string.regex`` set, or where nobody else reads these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import envelopes as N

# What each ciphertext is bound to, and the kind of run that comes along.
CHAPTER_BOUND = "chapter"
RESULT_BOUND = "analysis-final"
PROMPT_BOUND = "analysis-prompt"
PART_BOUND = "analysis-summary-part"
FACT_BOUND = "l2-fact"
MODE = "l2_query"

_IV, _TAG = 12, 16
#: Columns of ciphertexts and keyed hashes, which plain tables don't have.
_OLD = ("ciphertext", "iv", "tag", "algorithm", "prompt_ciphertext", "prompt_iv", "prompt_tag", "content_hmac", "source_hmac")
#: Sealed tables that a store must have, and tables that take a chapter's hash.
_SEALED = ("chapters", "runs", "facts")
_HASHED = ("routes", "statuses")


class MigrationError(ValueError):
    """The store isn't a sealed one, the target exists, or a chapter can't be opened."""


def bound(kind: str, *parts: Column) -> Column:
    """The authenticated data of a ciphertext: its kind and key, joined by colons."""
    return F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])


def part_key(key: Column) -> Column:
    """A part's key as it is bound: trimmed, 240 characters at most."""
    return F.substring(F.trim(F.coalesce(key, F.lit(""))), 1, 240)


def unsealed(ciphertext: Column, iv: Column, tag: Column, key: bytes, aad: Column) -> Column:
    """The text of a ciphertext; null if a piece is missing or malformed, the key is another one or it is bound to something else.

    All three are base64; the vector has 12 bytes, the tag 16.
    """
    c, i, t = (F.try_to_binary(x, F.lit("base64")) for x in (ciphertext, iv, tag))
    whole = F.when((F.length(i) == _IV) & (F.length(t) == _TAG), F.concat(i, c, t))
    return F.make_valid_utf8(F.try_aes_decrypt(whole, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad.cast("binary")).cast("string"))


def sealed(text: Column, key: bytes, aad: Column, iv: Column) -> list[Column]:
    """ciphertext, iv and tag of ``text``, the inverse of ``unsealed``; ``iv`` is binary."""
    all_ = F.aes_encrypt(text.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), iv, aad.cast("binary"))
    middle = F.substring(all_, F.lit(_IV + 1), F.length(all_) - _IV - _TAG)
    return [F.base64(middle).alias("ciphertext"), F.base64(iv).alias("iv"), F.base64(F.substring(all_, F.length(all_) - _TAG + 1, F.lit(_TAG))).alias("tag")]


def chapters(rows: DataFrame, key: bytes) -> DataFrame:
    """Chapters with content, its length in code points, its hash, and ``__damaged``."""
    text = unsealed(F.col("ciphertext"), F.col("iv"), F.col("tag"), key, bound(CHAPTER_BOUND, F.col("book_id"), F.col("chapter_index")))
    r = rows.withColumn("content", text)
    r = r.withColumns({"content_length": F.length("content"), "content_hash": F.sha2("content", 256), "__damaged": F.col("content").isNull()})
    return r.drop(*_OLD)


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _warnings(*found: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(when, F.lit(text)) for when, text in found]))


def snapshot(v: Column) -> Column:
    """What stays of a prompt's snapshot (variant): its mode, the query, and the keys of its index groups, as JSON."""
    query = F.coalesce(N.plain(N.present(v, "l2_query.query", "query")), F.lit(""))
    keys = F.coalesce(F.try_variant_get(v, "$.index_group_keys", "array<variant>"), F.array().cast("array<variant>"))
    return F.to_json(F.struct(F.lit(MODE).alias("analysis_mode"), query.alias("query"), keys.alias("index_group_keys")))


def runs(rows: DataFrame, key: bytes) -> DataFrame:
    """Runs with prompt_snapshot and result, ``__migrated`` and ``__warnings``.

    Only runs whose prompt can be read and is of the mode ``MODE`` come along; of all others no text is kept.
    """
    prompt = unsealed(F.col("prompt_ciphertext"), F.col("prompt_iv"), F.col("prompt_tag"), key, bound(PROMPT_BOUND, F.col("id")))
    result = unsealed(F.col("ciphertext"), F.col("iv"), F.col("tag"), key, bound(RESULT_BOUND, F.col("id")))
    r = rows.withColumn("__v", F.try_parse_json(F.when(_filled("prompt_ciphertext"), prompt)))
    r = r.withColumn("__migrated", F.coalesce(F.try_variant_get("__v", "$.analysis_mode", "string") == MODE, F.lit(False)))
    r = r.withColumn("result", F.when(F.col("__migrated") & _filled("ciphertext"), result))
    warned = _warnings((_filled("prompt_ciphertext") & F.col("__v").isNull(), "prompt can't be read, run left out"), (F.col("__migrated") & _filled("ciphertext") & F.col("result").isNull(), "result can't be read, left empty"))
    r = r.withColumns({"prompt_snapshot": F.when(F.col("__migrated"), snapshot(F.col("__v"))), "__warnings": warned})
    return r.drop("__v", *_OLD)


def parts(rows: DataFrame, kept_runs: DataFrame, key: bytes) -> DataFrame:
    """Parts of ``kept_runs`` (id) with result and ``__warnings``."""
    text = unsealed(F.col("ciphertext"), F.col("iv"), F.col("tag"), key, bound(PART_BOUND, F.col("analysis_id"), part_key(F.col("part_key"))))
    r = rows.join(kept_runs.select(F.col("id").alias("analysis_id")), "analysis_id", "left_semi")
    r = r.withColumn("result", F.when(_filled("ciphertext"), text))
    return r.withColumn("__warnings", _warnings((_filled("ciphertext") & F.col("result").isNull(), "result can't be read, left empty"))).drop(*_OLD)


def facts(rows: DataFrame, key: bytes) -> DataFrame:
    """Facts with fact, evidence, review_note and ``__warnings``; what can't be read is empty."""
    text = unsealed(F.col("ciphertext"), F.col("iv"), F.col("tag"), key, bound(FACT_BOUND, F.col("id")))
    r = rows.withColumn("__v", F.try_parse_json(F.when(_filled("ciphertext"), text)))
    v = F.col("__v")
    evidence = F.coalesce(F.try_variant_get(v, "$.evidence", "array<string>"), F.array().cast("array<string>"))
    field = {c: F.coalesce(N.plain(N.present(v, c)), F.lit("")) for c in ("fact", "review_note")}
    warned = _warnings((_filled("ciphertext") & v.isNull(), "fact can't be read, left empty"))
    return r.withColumns({**field, "evidence": evidence, "__warnings": warned}).drop("__v", *_OLD)


def with_source_hash(rows: DataFrame, plain_chapters: DataFrame) -> DataFrame:
    """rows with the hash of their chapter's text as source_hash; '' where there is no such chapter."""
    h = plain_chapters.select("book_id", "chapter_index", F.col("content_hash").alias("__hash"))
    joined = rows.drop("source_hash", *_OLD).join(h, ["book_id", "chapter_index"], "left")
    return joined.withColumn("source_hash", F.coalesce("__hash", F.lit(""))).drop("__hash")


@dataclass(frozen=True)
class Migrated:
    """A finished migration in ``folder``."""

    spark: SparkSession
    folder: str

    def counts(self) -> DataFrame:
        """tbl and n: rows of each table; of runs also those that were left out (runs_skipped)."""
        if not _exists(self.spark, f"{self.folder}/counts/_SUCCESS"):
            raise MigrationError(f"{self.folder} has no finished migration")
        return self.spark.read.schema("tbl string, n bigint").parquet(f"{self.folder}/counts")

    def _raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def table(self, name: str) -> DataFrame:
        self.counts()
        rows = self._raw(name)
        return (rows.where("__migrated") if name == "runs" else rows).drop("__migrated", "__warnings", "__damaged")

    def warnings(self) -> DataFrame:
        """tbl, key and message of each text that couldn't be read."""
        self.counts()
        keys = {"runs": F.col("id").cast("string"), "parts": F.concat_ws("/", "analysis_id", "part_key"), "facts": F.col("id").cast("string")}
        each = [self._raw(t).where("size(__warnings) > 0").select(F.lit(t).alias("tbl"), k.alias("key"), F.explode("__warnings").alias("message")) for t, k in keys.items() if _exists(self.spark, f"{self.folder}/{t}")]
        found = each[0]
        for e in each[1:]:
            found = found.unionByName(e)
        return found


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _path(spark, folder)
    return fs.exists(path)


def _require(store: dict[str, DataFrame]) -> None:
    for name in _SEALED:
        if name not in store or "ciphertext" not in store[name].columns:
            raise MigrationError(f"{name}.ciphertext is missing: this isn't a sealed store")


def migrate(spark: SparkSession, store: dict[str, DataFrame], key: bytes, folder: str) -> Migrated:
    """Write the tables of ``store`` in plain below ``folder``, which mustn't exist.

    ``store``: chapters, runs and facts; parts, routes and statuses, if there are any; every other table is copied as it is
    (leave out what has no use in the new store).  A chapter that can't be opened is an error, and so is a wrong
    key: nothing of the target stays then.  Empty tables give empty tables.
    """
    if len(key) != 32:
        raise MigrationError("the key must have 32 bytes")
    _require(store)
    if _exists(spark, folder):
        raise MigrationError(f"{folder} exists")
    counts: dict[str, int] = {}

    def write(name: str, rows: DataFrame, **more: Column) -> dict[str, int]:
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n"), *[F.coalesce(c, F.lit(0)).alias(k) for k, c in more.items()]).write.parquet(f"{folder}/{name}")
        counts[name] = seen.get["n"]
        return seen.get

    try:
        if damaged := write("chapters", chapters(store["chapters"], key), damaged=F.count_if("__damaged"))["damaged"]:
            raise MigrationError(f"{damaged} of {counts['chapters']} chapters can't be opened; is it the right key?")
        plain_chapters = spark.read.parquet(f"{folder}/chapters")
        migrated = write("runs", runs(store["runs"], key), migrated=F.count_if("__migrated"))["migrated"]
        counts |= {"runs": migrated, "runs_skipped": counts["runs"] - migrated}
        if "parts" in store:
            write("parts", parts(store["parts"], spark.read.parquet(f"{folder}/runs").where("__migrated"), key))
        write("facts", with_source_hash(facts(store["facts"], key), plain_chapters))
        for name in [n for n in _HASHED if n in store]:
            write(name, with_source_hash(store[name], plain_chapters))
        for name in [n for n in store if n not in (*_SEALED, *_HASHED, "parts")]:
            write(name, store[name])
        spark.createDataFrame(list(counts.items()), "tbl string, n bigint").coalesce(1).write.parquet(f"{folder}/counts")
    except BaseException:
        fs, path = _path(spark, folder)
        fs.delete(path, True)
        raise
    return Migrated(spark, folder)
