"""Sessions and uploads: names, expiry and limits, and the folders that sessions have on a shared store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilworks.functions.stores import store_at

MAX_UPLOAD, MAX_MAPPING = 100 * 1024 * 1024, 10 * 1024 * 1024


def valid_session(session: Column) -> Column:
    return session.rlike("^[a-f0-9]{8}$")


def valid_filename(name: Column) -> Column:
    return name.rlike(r"^[a-zA-Z0-9._\-]+$") & ~name.isin(".", "..")


def accepted_upload(name: Column, length: Column) -> Column:
    return F.lower(name).endswith(".docx") & (length <= MAX_UPLOAD)


def accepted_mapping(name: Column, length: Column) -> Column:
    return F.lower(name).endswith(".json") & (length <= MAX_MAPPING)


def resolve(requests: DataFrame, present: DataFrame) -> DataFrame:
    """Requests (session_id, name) whose parts are valid and whose file is present (session_id, name)."""
    fit = valid_session(F.col("session_id")) & valid_filename(F.col("name"))
    return requests.filter(fit).join(present.select("session_id", "name").distinct(), ["session_id", "name"], "left_semi")


def create(spark, n: int) -> DataFrame:
    """n new sessions with a random id and the present time."""
    return spark.range(n).select(F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 8).alias("session_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssZ").alias("created"))


def expired(sessions: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """sessions with `expired`: an unreadable or missing time counts as expired."""
    at = F.try_to_timestamp("created", F.lit("yyyy-MM-dd'T'HH:mm:ssZ"))
    return sessions.withColumn("expired", ~F.coalesce(at > now - F.expr(f"INTERVAL {hours} HOURS"), F.lit(False)))


STAMP = ".created"


def store(sessions: DataFrame, folder: str) -> None:
    """A folder for each session (session_id, created) below `folder`, with its time in a file."""

    def write(rows) -> None:
        store, base = store_at(folder)
        for r in rows:
            store.create_dir(f"{base}/{r['session_id']}", recursive=True)
            with store.open_output_stream(f"{base}/{r['session_id']}/{STAMP}") as f:
                f.write((r["created"] or "").encode())

    sessions.select("session_id", "created").foreachPartition(write)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, created) of all session folders; created is null where a folder has no readable time."""
    listing, base = store_at(folder)
    names = [(i.base_name,) for i in listing.get_file_info(stores.FileSelector(base, allow_not_found=True)) if i.type == stores.FileType.Directory]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = store_at(folder)
        for f in frames:
            times = []
            for name in f["session_id"]:
                try:
                    with store.open_input_stream(f"{base}/{name}/{STAMP}") as stamp:
                        times.append(stamp.read().decode().strip())
                except (OSError, UnicodeDecodeError):
                    times.append(None)
            yield pd.DataFrame({"session_id": f["session_id"], "created": times})

    return spark.createDataFrame(names, "session_id string").mapInPandas(read, "session_id string, created string")


def clean_up(spark: SparkSession, folder: str, now: Column, hours: int = 24) -> DataFrame:
    """Delete the folders of expired sessions below `folder`; (session_id, removed) of those found expired."""
    gone = expired(stored(spark, folder), now, hours).filter("expired").select("session_id")

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = store_at(folder)
        for f in frames:
            done = []
            for name in f["session_id"]:
                try:
                    store.delete_dir(f"{base}/{name}")
                    done.append(True)
                except OSError:  # another run of the task has removed it, or it cannot be removed
                    done.append(store.get_file_info(f"{base}/{name}").type == stores.FileType.NotFound)
            yield pd.DataFrame({"session_id": f["session_id"], "removed": done})

    rows = gone.mapInPandas(remove, "session_id string, removed boolean").collect()  # one row a folder
    return spark.createDataFrame(rows, "session_id string, removed boolean")
