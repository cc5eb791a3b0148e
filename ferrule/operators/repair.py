"""Repairs as plans: rows that say what to cut or to rename. Files are never changed; a plan is applied to copies."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators import edits, registry, structures
from ferrule.operators.registry import renamed
from ferrule.options import Severity
from ferrule.storage import written

#: Longest tail that may be taken for a watermark.
TAIL = 1000


def watermark(content: Column, valid_size: Column, size: Column) -> Column:
    """none, possible or probable: whether what follows the valid part is a short run of plain text."""
    tail = F.substring(content, (valid_size + 1).cast("int"), (size - valid_size).cast("int"))
    plain = F.rlike(F.hex(tail), F.lit("^(?:[2-6][0-9A-F]|7[0-9A-E]|0[09AD])+$"))
    return F.when(size <= valid_size, "none").when((size - valid_size <= TAIL) & plain, "probable").otherwise("possible")


def plans(files: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(path, kind, offset, cut, insert, new_name) of files (path, name, size, valid_size, format, is_misnamed, and watermark or content), and of splices where they have them.

    more: path and splices of files whose repairs come from others.
    """
    none = F.lit(None)
    extension = F.split_part(F.split_part("format", F.lit(" "), F.lit(1)), F.lit("/"), F.lit(1))
    move = files.where("is_misnamed").select("path", F.lit("rename").alias("kind"), none.cast("long").alias("offset"), none.cast("long").alias("cut"), none.cast("binary").alias("insert"), renamed(F.col("name"), extension).alias("new_name"))
    if "splices" in files.columns:
        cut = files.select("path", F.inline("splices"))
    else:
        mark = F.col("watermark") if "watermark" in files.columns else watermark(F.col("content"), F.col("valid_size"), F.col("size"))
        cut = files.where(mark == "probable").select("path", F.lit("trim").alias("kind"), F.col("valid_size").alias("offset"), (F.col("size") - F.col("valid_size")).alias("cut"), none.cast("binary").alias("insert"))
    if more is not None:
        cut = cut.union(more.select("path", F.inline("splices")))
    return cut.withColumn("new_name", none.cast("string")).union(move)


def repaired(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, name, content) as they would be, of files that the plan names; content is null where their splices overlap."""
    script = edits.scripts(plan)
    out = files.select("path", "name", "content").join(script, "path")
    changed = F.when(F.size("splices") > 0, edits.applied(F.col("content"), F.col("splices"))).otherwise(F.col("content"))
    return out.select("path", F.coalesce("new_name", "name").alias("name"), changed.alias("content"))


def judged(copies: DataFrame) -> DataFrame:
    """copies (path, name, content) with refused: why a copy may not be written, null if it may. Copies are walked again.

    Refused are copies without content (overlapping splices), and those in which checksums fail or the structure is broken.
    """
    ext = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    known = registry.identify(copies.withColumn("ext", ext))
    first = known.withColumn("format", F.split_part(F.split_part("format", F.lit(" "), F.lit(1)), F.lit("/"), F.lit(1)))
    told = structures.walked(first).withColumns(structures.checks(F.col("pieces")))
    why = F.when(F.col("content").isNull(), "splices overlap").when(F.col("n_bad") > 0, "checksums fail").when(F.size("faults") > 0, F.concat(F.lit("faults: "), F.array_join("faults", ", ")))
    return told.select("path", "name", "content", why.alias("refused"))


def write_copies(files: DataFrame, plan: DataFrame, out: str, confirmed: bool = False, levels: DataFrame | None = None) -> DataFrame:
    """Writes repaired copies under out, a folder that all executors share; does nothing unless confirmed.

    Returns (path, written, ok, error), a row for each file of the plan. Files whose level (path, max_level) is an error are
    refused, and so are copies that are broken. The copies are staged under names of their own first, and the table of what
    was staged decides: Spark commits it whole, with the rows of finished attempts alone. Then each staged copy is moved to its
    place, which a task may do again. What killed attempts have left goes with the staging folder. Rows that are not ok
    may be given to this function again.
    """
    done = judged(repaired(files, plan))
    if levels is not None:
        wrong = levels.where(F.col("max_level") >= int(Severity.ERROR)).select("path", F.lit("file has errors").alias("_wrong"))
        done = done.join(wrong, "path", "left").withColumn("refused", F.coalesce("_wrong", "refused")).drop("_wrong")
    if not confirmed:
        return done.select("path", F.lit(None).cast("string").alias("written"), F.lit(False).alias("ok"), F.coalesce("refused", F.lit("not confirmed")).alias("error"))
    job = f"_staging-{uuid.uuid4().hex}"
    target = F.concat(F.substring(F.sha1("path"), 1, 8), F.lit("-"), "name")
    staged = written(done.select("path", target.alias("target"), F.when(F.col("refused").isNull(), F.col("content")).alias("content"), "refused").mapInArrow(_stage(out, job), _STAGED), "staged")
    moved = written(staged.mapInArrow(_move(out, job), "path string, written string, ok boolean, error string"), "moved")
    store, root = _store(out)
    store.delete_dir_contents(f"{root}/{job}", missing_dir_ok=True)
    if store.get_file_info(f"{root}/{job}").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/{job}")
    return moved


_STAGED = "path string, target string, staged string, error string"


def _store(out: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in out or out.startswith("file:"):
        return fs.FileSystem.from_uri(out)
    return fs.LocalFileSystem(), out.rstrip("/")


def _stage(out: str, job: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out)
        for batch in batches:
            rows = []
            for path, target, content, refused in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, error = None, refused
                if error is None:
                    name = f"{root}/{job}/{uuid.uuid4().hex}"
                    try:
                        store.create_dir(f"{root}/{job}", recursive=True)
                        with store.open_output_stream(name) as f:
                            f.write(content)
                    except OSError as failed:
                        name, error = None, str(failed)
                rows.append((path, target, name, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["path", "target", "staged", "error"])

    return run


def _move(out: str, job: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out)
        for batch in batches:
            rows = []
            for path, target, staged, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = f"{root}/{target}"
                if staged is not None:
                    try:
                        if store.get_file_info(staged).type == fs.FileType.File:
                            store.move(staged, place)
                        elif store.get_file_info(place).type != fs.FileType.File:  # else an earlier attempt has moved it
                            error = "staged copy is lost"
                    except OSError as failed:
                        error = str(failed)
                ok = staged is not None and error is None
                rows.append((path, place if ok else None, ok, error))
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "written", "ok", "error"])

    return run
