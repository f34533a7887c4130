"""Reading images and sidecar documents, and turning documents into tables."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photoflow.functions.documents import TOOL_KEYS, counted, parsed
from photoflow.scratch import materialize, partitions

IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "tiff", "bmp", "webp"]
SKIPPED = ["venv", "__pycache__", ".git", "node_modules"]


def image_catalog(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, modified, length) of the image files under root, without reading their bytes, ordered by path."""
    return stored_files(spark, root, rf"(?i).*\.({'|'.join(IMAGE_EXTENSIONS)})$", SKIPPED if recursive else (), recursive).orderBy("path")


def _store(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what comes before that to make the names that Spark gives."""
    scheme, mark, rest = path.partition("://")
    if not mark:
        scheme, mark, rest = "file", "://", path.removeprefix("file:")
    fs, top = pafs.FileSystem.from_uri(f"{scheme}{mark}{quote(rest, safe="/:@")}")
    top = "/" + top.strip("/") if top.startswith("/") else top.rstrip("/")
    return fs, top, "file:" if scheme == "file" else path.rstrip("/").removesuffix(top)


def stored_files(spark: SparkSession, root: str, wanted: str, skipped: Sequence[str] = (), recursive: bool = True) -> DataFrame:
    """(path, modified, length) of the files under root whose names match `wanted`, a regular expression.

    Folders are dealt out over tasks, which list them; those found are listed in the next round, so no list of
    files passes the driver. Names that begin with a dot or an underscore are left out, as Spark's readers do. A
    store that Arrow doesn't know is listed by Spark's own reader, on the driver.
    """
    try:
        top = _store(root)[1]
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
        found = files.select("path", F.col("modificationTime").alias("modified"), "length").where(F.element_at(F.split("path", "/"), -1).rlike(f"^{wanted}"))
        for s in skipped:
            found = found.where(~F.contains("path", F.lit(f"/{s}/")))
        return found.dropDuplicates(["path"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _, before = _store(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = [f for f in fs.get_file_info(pafs.FileSelector(folder)) if not f.base_name.startswith(".") and (f.base_name[0] != "_" or "=" in f.base_name)]
                downs = [f.path for f in found if recursive and f.type == pafs.FileType.Directory and f.base_name not in skipped]
                files = [f for f in found if f.type == pafs.FileType.File and re.match(wanted, f.base_name)]
                for k in range(0, len(downs), 10_000):
                    part = downs[k : k + 10_000]
                    yield pa.record_batch({"path": part, "folder": [True] * len(part), "modified": pa.nulls(len(part), pa.timestamp("us", "UTC")), "length": pa.nulls(len(part), pa.int64())})
                for k in range(0, len(files), 10_000):
                    part = files[k : k + 10_000]
                    at = pa.array([f.mtime_ns // 1_000_000 * 1000 for f in part], pa.int64()).cast(pa.timestamp("us", "UTC"))
                    yield pa.record_batch({"path": [before + f.path for f in part], "folder": [False] * len(part), "modified": at, "length": pa.array([f.size for f in part], pa.int64())})

    level, found = spark.createDataFrame([(top,)], "path string"), None
    while True:
        listed = materialize(level.repartition(partitions(spark), "path").mapInArrow(scan, "path string, folder boolean, modified timestamp, length long"), "listed-folders")
        found = listed if found is None else found.unionByName(listed)
        level = listed.where("folder").select("path")
        if level.isEmpty():
            return found.where("not folder").select("path", "modified", "length")


def with_text(files: DataFrame) -> DataFrame:
    """files (path, ...) with `doc`, the whole text of each, read by the tasks; of a store that Arrow doesn't know by Spark's reader."""
    some = files.select("path").first()
    try:
        if some:
            _store(some[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        paths = [r[0] for r in files.select("path").collect()]
        text = files.sparkSession.read.option("wholetext", "true").text(paths)
        return files.join(text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc")), "path")
    at = files.columns.index("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, docs = b.slice(k, 256), []
                for path in part.column(at).to_pylist():
                    if before is None or not path.startswith(before):
                        fs, _, before = _store(path)
                    with fs.open_input_stream(path.removeprefix(before)) as f:
                        docs.append(f.read().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(docs, pa.string())], names=[*b.schema.names, "doc"])

    return files.repartition(partitions(files.sparkSession)).mapInArrow(read, files.select("*", F.lit("").alias("doc")).schema)


def list_files(spark: SparkSession, root: str, extensions: list[str] | None = IMAGE_EXTENSIONS, skipped: list[str] = SKIPPED) -> DataFrame:
    """(path, length, modified, is_link, target, broken) of the files under root, links among them.

    Folders are dealt out over tasks, each of which lists its own; the folders found are listed in the next
    round, until there are none. Links to folders are not followed; a link's length and time are those
    of its target, null where it leads nowhere. root is a folder of a file system that every machine has
    mounted; stores without links are listed by image_catalog. Without extensions all files count.
    """
    top = root.removeprefix("file://") if root.startswith("file://") else root.removeprefix("file:")
    if "://" in top:
        raise ValueError(f"{root} is in no mounted file system; use image_catalog")
    ends = tuple(f".{e.lower()}" for e in extensions) if extensions else None
    schema = "path string, folder boolean, length long, modified timestamp, is_link boolean, target string, broken boolean"
    columns = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["path"]:
                rows = []
                for e in os.scandir(folder):
                    link, down = e.is_symlink(), e.is_dir(follow_symlinks=False)
                    if (down and e.name not in skipped) or (not down and not e.is_dir() and (ends is None or e.name.lower().endswith(ends))):
                        broken = link and not os.path.exists(e.path)
                        st = None if broken or down else e.stat()
                        at = st and pd.Timestamp(st.st_mtime_ns // 1000, unit="us", tz="UTC")
                        rows.append((e.path, down, st and st.st_size, at, link, os.path.realpath(e.path) if link else None, broken))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns).astype({"length": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"length": "Int64"})

    level, found = spark.createDataFrame([(top,)], "path string"), None
    while True:
        listed = materialize(level.repartition(partitions(spark), "path").mapInPandas(scan, schema), "listed-folders")
        found = listed if found is None else found.unionByName(listed)
        level = listed.where("folder").select("path")
        if level.isEmpty():
            return found.where("not folder").drop("folder")


def legacy_faces(documents: DataFrame, key: str = "image", padding: float = 0.25) -> DataFrame:
    """Faces of documents of the two older forms, one row each, with the area to cut out.

    The detector's faces count where the document has its list, and only those with an encoding; their crop
    area is as it was stored. Else the extractor's faces count, without encodings; their area is the box with
    its border_padding (`padding` where unset), whole pixels, on every side, from 0 on at the upper left.
    """
    box = "struct<x:double,y:double,width:double,height:double>"
    item = f"array<struct<face_id:string,confidence:double,face_encoding:array<double>,coordinates:{box},crop_area:{box},detection_scale_factor:double,border_padding:double>>"
    read = lambda form: F.from_json(F.get_json_object("doc", f"$.{form}.faces"), item)
    both = documents.select(key, read("Face_detector").alias("d"), read("Face_extractor").alias("e"))
    rows = both.select(key, F.col("d").isNotNull().alias("own"), F.posexplode(F.coalesce("d", "e")).alias("pos", "f"))
    at = {c: F.col(f"f.coordinates.{c}") for c in ("x", "y", "width", "height")}
    pad = {c: (at[c] * F.coalesce("f.border_padding", F.lit(padding))).cast("long") for c in ("width", "height")}
    cut = {
        "x": F.greatest(F.lit(0.0), at["x"] - pad["width"]), "y": F.greatest(F.lit(0.0), at["y"] - pad["height"]),
        "width": at["width"] + 2 * pad["width"], "height": at["height"] + 2 * pad["height"],
    }
    crop = [F.when(F.col("own"), F.col(f"f.crop_area.{c}")).otherwise(v).cast("long").alias(f"crop_{c}") for c, v in cut.items()]
    kept = rows.where(~F.col("own") | F.col("f.face_encoding").isNotNull())
    return kept.select(
        key, "pos", F.when(F.col("own"), "detector").otherwise("extractor").alias("origin"), F.col("f.face_id").alias("face_id"), *[v.cast("long").alias(c) for c, v in at.items()],
        F.col("f.confidence").alias("confidence"), F.when(F.col("own"), F.col("f.face_encoding")).alias("encoding"), *crop,
        F.when(F.col("own"), F.col("f.detection_scale_factor")).otherwise(1.0).alias("scale"),
    )


def read_sidecars(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """(path, doc, valid): one row per file; a file that is no JSON stays as a row that is not valid."""
    text = with_text(stored_files(spark, root, fnmatch.translate(glob)))
    return text.select(named("path"), "doc").withColumn("valid", parsed(F.col("doc")).isNotNull())


def named(path: str) -> Column:
    """A path of stored_files as Spark's text reader names it."""
    return F.regexp_replace(path, "^file:/+", "file:///").alias("path")


def explode_operations(sidecars: DataFrame) -> DataFrame:
    """(..., op, backend, success, payload): one row per operation with a result, flat or nested by backend.

    Broken documents give no row. sidecar_info is no operation.
    """
    ops = sidecars.select("*", F.explode(F.from_json("doc", "map<string,string>")).alias("op", "payload")).where("op <> 'sidecar_info'").drop("doc")
    flat = ops.where(F.get_json_object("payload", "$.success").isNotNull()).withColumn("backend", F.lit(None).cast("string"))
    nested = ops.where(F.get_json_object("payload", "$.success").isNull()).withColumn("_m", F.from_json("payload", "map<string,string>"))
    nested = nested.select(*[c for c in ops.columns if c != "payload"], F.explode("_m").alias("backend", "payload")).where(F.get_json_object("payload", "$.success").isNotNull())
    both = flat.unionByName(nested)
    return both.withColumn("success", F.get_json_object("payload", "$.success") == "true")


def merge_documents(documents: DataFrame, updates: DataFrame, key: str = "image") -> DataFrame:
    """(key, doc): every document with its new results put in, and a new document where there was none.

    updates is (key, op, backend, payload, at): JSON results in the order of `at`; at equal times a result for
    the whole operation comes before those of backends, then the smaller payload and operation. A result without backend
    replaces the operation with all that was under it, one with a backend only that backend's; everything
    else of the document stays. sidecar_info keeps what it has and gets last_updated and last_operation; where
    there is none it also gets created_at and operation_type from the first new result. A document that
    is no JSON object counts as missing, repeated ones as one of them (the largest text). Names are sorted.
    """
    k = F.col(key)
    order = F.struct("at", F.col("backend").isNotNull().alias("nested"), F.coalesce("backend", F.lit("")).alias("name"), "payload")
    new = updates.select(k, "op", "backend", "payload", "at", order.alias("o"))
    # of each operation the last whole result, and of each backend the last result after it
    whole = new.where("backend is null").groupBy(key, "op").agg(F.max("o").alias("w"))
    after = new.where("backend is not null").join(whole, [key, "op"], "left").where("w is null or o > w")
    nested = after.groupBy(key, "op", "backend").agg(F.max("o")["payload"].alias("payload"))
    nested = nested.groupBy(key, "op").agg(F.map_from_entries(F.collect_list(F.struct("backend", F.try_parse_json("payload")))).alias("nested"))
    old = documents.groupBy(key).agg(F.max(F.when(F.from_json("doc", "map<string,variant>").isNotNull(), F.col("doc"))).alias("doc"))
    old = old.select(k, F.explode(F.from_json("doc", "map<string,variant>")).alias("op", "v"))
    info = old.where("op = 'sidecar_info'").select(k, F.from_json(F.to_json("v"), "map<string,variant>").alias("info"))
    parts = old.where("op <> 'sidecar_info'").select(k, "op", F.to_json("v").alias("old"))
    parts = parts.join(whole.select(k, "op", F.col("w.payload").alias("whole")), [key, "op"], "full").join(nested, [key, "op"], "full")
    base = F.coalesce(F.from_json(F.coalesce("whole", "old"), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    value = F.when(F.col("nested").isNull(), F.coalesce("whole", "old")).otherwise(F.to_json(_sorted(_over(base, F.col("nested")))))
    parts = parts.select(k, "op", value.alias("json")).groupBy(key).agg(F.collect_list(F.struct("op", "json")).alias("parts"))
    said = new.groupBy(key).agg(F.min(F.struct("o", "op")).alias("first"), F.max(F.struct("o", "op")).alias("last"))
    both = parts.join(said, key, "left").join(info, key, "full")
    one = lambda name, c: F.struct(F.lit(name).alias("k"), _text(c).alias("v"))
    lasts = F.map_from_entries(F.array(one("last_updated", F.col("last.o.at")), one("last_operation", F.col("last.op"))))
    firsts = F.map_from_entries(F.array(one("created_at", F.col("first.o.at")), one("operation_type", F.col("first.op"))))
    none = F.create_map().cast("map<string,variant>")
    stamped = _over(F.when(F.col("info").isNull(), firsts).otherwise(F.col("info")), lasts)
    stamped = F.when(F.col("last").isNull(), F.coalesce("info", none)).otherwise(stamped)
    entries = F.transform(F.coalesce("parts", F.array().cast("array<struct<op:string,json:string>>")), lambda p: F.struct(p["op"].alias("k"), p["json"].alias("v")))
    entries = F.when(F.size(stamped) > 0, F.array_append(entries, F.struct(F.lit("sidecar_info").alias("k"), F.to_json(_sorted(stamped)).alias("v")))).otherwise(entries)
    doc = F.map_from_entries(F.transform(F.array_sort(entries), lambda e: F.struct(e["k"], F.try_parse_json(e["v"]))))
    return both.select(k, F.to_json(doc).alias("doc"))


def _text(c: Column) -> Column:
    """A string as a variant."""
    return F.try_variant_get(F.try_parse_json(F.to_json(F.struct(c.cast("string").alias("v")))), "$.v", "variant")


def _over(base: Column, more: Column) -> Column:
    """The map `base` with the entries of `more` put over its own."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more)


def _sorted(m: Column) -> Column:
    """A map in the order of its keys."""
    keys = F.array_sort(F.map_keys(m))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(m, k))))


def _found(documents: DataFrame, keys: list[str], own: Callable[[Column], Column], key: str = "image") -> DataFrame:
    """(key, found): (at, o) of the objects of every document reached through `keys`, to any depth, for which `own` is not null, in order.

    `at` orders them as a search that goes down before it goes on. Below an object with an `own` nothing is
    searched. A document is searched within its row, a depth at a time until no object is left.
    """
    node = lambda at, v: F.struct(at.alias("at"), v.alias("v"), own(v).alias("o"))
    child = lambda e, n, k: F.struct(F.concat(e["at"], F.lit(f"{n:02d}")).alias("at"), F.try_variant_get(e["v"], f"$.{k}", "variant").alias("v"))

    def below(e: Column) -> Column:
        there = F.filter(F.array(*[child(e, n, k) for n, k in enumerate(keys)]), lambda c: c["v"].isNotNull())
        return F.when(e["o"].isNotNull(), F.array(e)).otherwise(F.transform(there, lambda c: node(c["at"], c["v"])))

    def step(s: Column, _: Column) -> Column:
        down = F.struct(F.exists(s["e"], lambda e: e["o"].isNull()).alias("open"), F.flatten(F.transform(s["e"], below)).alias("e"))
        return F.when(s["open"], down).otherwise(s)

    # no object is deeper than there are braces; steps behind the last object do nothing
    braces = F.length("doc") - F.length(F.replace("doc", F.lit("{"), F.lit("")))
    docs = documents.select(key, F.coalesce(braces, F.lit(0)).alias("n"), F.try_parse_json("doc").alias("v"))
    start = F.struct(F.lit(True).alias("open"), F.array(node(F.lit(""), F.col("v"))).alias("e"))
    ends = F.aggregate(F.sequence(F.lit(0), "n"), start, step, lambda s: F.transform(F.filter(s["e"], lambda e: e["o"].isNotNull()), lambda e: F.struct(e["at"].alias("at"), e["o"].alias("o"))))
    return docs.select(key, ends.alias("found"))


def detection_counts(documents: DataFrame, key: str = "image") -> DataFrame:
    """(key, n): count or list length of each document (key, doc), else of the first object nested under data, result or detection that has one above 0, at any depth; 0 if none."""
    found = _found(documents, ["data", "result", "detection"], counted, key)
    first = F.get(F.filter("found", lambda e: (e["o"] > 0) | (e["at"] == "")), F.lit(0))
    return found.select(key, first.alias("f")).groupBy(key).agg(F.min("f")["o"].alias("n")).select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def tool_names(documents: DataFrame, key: str = "image") -> DataFrame:
    """(key, tool): the first tool name in a document, else in the objects nested under data, result or metadata, at any depth."""
    own = lambda v: F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in TOOL_KEYS])
    found = _found(documents, ["data", "result", "metadata"], own, key).select(key, F.get("found", F.lit(0)).alias("f"))
    return found.groupBy(key).agg(F.min("f")["o"].alias("tool"))


def with_operation(documents: DataFrame, op: str, key: str = "image") -> DataFrame:
    """(key, has): whether the operation is a key or the type of a document or of an object nested under data or result, at any depth."""
    has = lambda v: F.try_variant_get(v, f"$.{op}", "variant").isNotNull() | F.coalesce(F.try_variant_get(v, "$.sidecar_info.operation_type", "string") == op, F.lit(False))
    found = _found(documents, ["data", "result"], lambda v: F.when(has(v), True), key)
    return found.groupBy(key).agg(F.bool_or(F.size("found") > 0).alias("has"))


def export_sidecars(sidecars: DataFrame, op: str | None = None, doc: str = "doc") -> DataFrame:
    """(image, path, op, created, size): a row per operation of every sound document, of one kind with `op`."""
    rows = sidecars.withColumns({"created": F.get_json_object(doc, "$.sidecar_info.created_at"), "size": F.octet_length(doc)})
    out = explode_operations(rows).select("image", "path", "op", "created", "size")
    return out.where(F.col("op") == op) if op else out


def explode_detections(operations: DataFrame, key: str, image_col: str = "image") -> DataFrame:
    """(image, pos, item): one row per element of the payload's list `key` (faces, objects)."""
    items = F.from_json(F.get_json_object("payload", f"$.{key}"), "array<string>")
    return operations.select(image_col, F.posexplode(items).alias("pos", "item"))


def explode_faces(operations: DataFrame, max_faces: int | None = None, image_col: str = "image") -> DataFrame:
    """Faces that have an encoding: (image, pos, face_key, confidence, encoding); max_faces in image and list order."""
    f = explode_detections(operations, "faces", image_col)
    got = lambda k: F.get_json_object("item", f"$.{k}")
    out = f.select(
        image_col, "pos", F.concat_ws(":", F.col(image_col).cast("string"), F.coalesce(got("face_id"), F.col("pos").cast("string"))).alias("face_key"),
        got("confidence").cast("double").alias("confidence"), F.from_json(got("encoding"), "array<double>").alias("encoding"),
    ).where("encoding is not null and size(encoding) > 0")
    return out.orderBy(image_col, "pos").limit(max_faces) if max_faces else out


def explode_objects(operations: DataFrame, image_col: str = "image") -> DataFrame:
    got = lambda k: F.get_json_object("item", f"$.{k}")
    return explode_detections(operations, "objects", image_col).select(image_col, "pos", got("class").alias("class"), got("confidence").cast("double").alias("confidence"))


def crop_manifest(objects: DataFrame, width: Column, height: Column, image_col: str = "image", types: list[str] | None = None) -> DataFrame:
    """One row per object to cut: output name image_class_nn.jpg, numbered by class, and the clamped box."""
    from pyspark.sql import Window

    o = objects.where(F.lower("class").isin([t.lower() for t in types])) if types else objects
    n = F.row_number().over(Window.partitionBy(image_col, "class").orderBy("ord"))
    box = {"x1": F.greatest(F.lit(0), F.col("x").cast("bigint")), "y1": F.greatest(F.lit(0), F.col("y").cast("bigint")), "x2": F.least(width, (F.col("x") + F.col("w")).cast("bigint")), "y2": F.least(height, (F.col("y") + F.col("h")).cast("bigint"))}
    name = F.concat(F.col(image_col).cast("string"), F.lit("_"), F.col("class"), F.lit("_"), F.lpad(n.cast("string"), 2, "0"), F.lit(".jpg"))
    return o.select(image_col, "ord", "class", n.alias("n"), name.alias("name"), *[v.cast("bigint").alias(k) for k, v in box.items()])


def write_manifest(rows: DataFrame, path: str, by: str = "folder") -> None:
    """Write rows as JSON files in one folder per value of `by`."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def migrate_sidecars(sidecars: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Operations of all documents as a Parquet table; with dry_run only the rows that would be written."""
    rows = explode_operations(sidecars)
    if not dry_run:
        rows.write.mode("overwrite").parquet(path)
        rows = sidecars.sparkSession.read.schema(rows.schema).parquet(path)
    return rows


def write_files(rows: DataFrame, root: str, name: str, content: Column) -> None:
    """One file per row under root, named by the column `name` (folders allowed), with the content as text.

    Written by the tasks through the file system of root, under a name of its own and then renamed.
    """
    import uuid

    def write(batches):
        uri = root if "://" in root or root.startswith("file:") else f"file://{root}"
        fs, top = pafs.FileSystem.from_uri(uri)
        made = None
        for b in batches:
            for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{top}/{n}"
                folder = path.rsplit("/", 1)[0]
                if folder != made:
                    fs.create_dir(folder, recursive=True)
                    made = folder
                with fs.open_output_stream(own := f"{folder}/.{uuid.uuid4().hex}") as f:
                    f.write((text or "").encode())
                fs.move(own, path)
        yield from ()

    # rows by folder: a small table of one part fills many tasks, and no two tasks write many files into one folder
    folder = F.regexp_replace("n", "[^/]*$", "")
    dealt = rows.select(F.col(name).alias("n"), content.alias("c")).repartition(partitions(rows.sparkSession), folder).sortWithinPartitions(folder)
    dealt.mapInArrow(write, "n string").write.format("noop").mode("overwrite").save()


def spread(name: Column, folders: int = 256) -> Column:
    """The name in one of so many folders by its hash, so that many tasks write and list them."""
    return F.concat(F.lpad(F.pmod(F.xxhash64(name), F.lit(folders)).cast("string"), 3, "0"), F.lit("/"), name)


def write_report_json(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON, nulls included."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str, noise: DataFrame | None = None, cluster: str = "cluster_id") -> None:
    """Rows as CSV with a header; `noise` (the same columns but the cluster) is added with cluster -1."""
    every = rows if noise is None else rows.unionByName(noise.withColumn(cluster, F.lit(-1)).select(*rows.columns))
    every.write.mode("overwrite").option("header", "true").csv(path)


def game_folder(game_id: Column, start: Column, end: Column) -> Column:
    """Folder of a game: Game{id}_{day}_{start}-{end}."""
    return F.concat(F.lit("Game"), game_id.cast("string"), F.lit("_"), F.date_format(start, "ddMMMyyyy"), F.lit("_"), F.date_format(start, "HHmmss"), F.lit("-"), F.date_format(end, "HHmmss"))


def team_folder(teams: Column) -> Column:
    """Folder of a photo by its teams (array): the one team, MultiTeam or NoTeam (also for null)."""
    n = F.size(teams)
    return F.when(n == 1, teams[0]).when(n > 1, "MultiTeam").otherwise("NoTeam")


def person_folder(cluster_id: Column) -> Column:
    """person_{nn}, or unclustered."""
    return F.when(cluster_id < 0, "unclustered").otherwise(F.concat(F.lit("person_"), F.when(cluster_id < 100, F.lpad(cluster_id.cast("string"), 2, "0")).otherwise(cluster_id.cast("string"))))


def write_layout(assignments: DataFrame, path: str, folders: list[Column]) -> DataFrame:
    """Write where every row belongs (JSON manifests, one folder of folders each) and count the rows placed in each."""
    placed = assignments.withColumn("folder", F.concat_ws("/", *folders))
    write_manifest(placed, path)
    return placed.groupBy("folder").agg(F.count("*").alias("placed"))
