"""Image files: inventory with decoding errors as rows, perceptual hashes, coverage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfmark.contracts import IMAGE_HASHES, IMAGES, check_schema, conform, demand, repeated, violations

#: Leading bytes of image formats.
MAGIC = {b"\xff\xd8\xff": "JPEG", b"\x89PNG\r\n\x1a\n": "PNG", b"GIF8": "GIF", b"BM": "BMP", b"RIFF": "WEBP", b"II*\x00": "TIFF", b"MM\x00*": "TIFF"}
#: Channels of a decoded image to its colour mode.
MODES = {1: "L", 3: "RGB", 4: "RGBA"}


def _format() -> F.Column:
    out = F.lit(None).cast("string")
    for mark, name in MAGIC.items():
        out = F.when(F.expr(f"substring(content, 1, {len(mark)}) = X'{mark.hex()}'"), name).otherwise(out)
    return out


def _place(column: str) -> F.Column:
    """A path with one slash after its scheme: readers differ in that."""
    return F.regexp_replace(column, "^([a-z0-9]+):/+", "$1:/")


def _non_negative(text: F.Column) -> F.Column:
    n = text.try_cast("long")
    return F.when(n >= 0, n)


def scan_images(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """IMAGES of all files under root, but hidden ones and archive metadata.

    id is the first folder if a non-negative integer, image_index the file's stem if one.  Files are decoded by the JVM;
    one that cannot be is a row with status error, without format or size in pixels.
    """
    opts = {"recursiveFileLookup": "true"}
    files = spark.read.format("binaryFile").options(**opts).load(root)
    shown = spark.read.format("image").options(dropInvalid="false", **opts).load(root)
    shown = shown.select(F.col("image.origin").alias("origin"), F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("channels"))
    base = F.lit(root.removeprefix("file://").rstrip("/") + "/")
    rows = files.select("path", "length", _format().alias("format")).join(shown, _place("path") == _place("origin"), "left")
    rows = rows.withColumn("relative_path", F.element_at(F.split(F.col("path"), F.concat(F.lit(r"\Q"), base, F.lit(r"\E"))), -1))
    rows = rows.filter(~F.col("relative_path").rlike(r"(^|/)(__MACOSX|\.[^/]*|Thumbs\.db)(/|$)"))
    parts, name = F.split("relative_path", "/"), F.element_at(F.split("relative_path", "/"), -1)
    ok = F.coalesce(F.col("w") > 0, F.lit(False))
    mode = F.lit(None).cast("string")
    for channels, m in MODES.items():
        mode = F.when(F.col("channels") == channels, m).otherwise(mode)
    rows = rows.select(
        F.when(F.size(parts) >= 2, _non_negative(parts[0])).alias("id"),
        _non_negative(F.regexp_replace(name, r"\.[^.]*$", "")).alias("image_index"),
        "relative_path",
        F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)).alias("extension"),
        F.when(ok, F.col("format")).alias("format"),
        F.when(ok, F.col("w")).alias("width"),
        F.when(ok, F.col("h")).alias("height"),
        F.when(ok, mode).alias("mode"),
        F.col("length").alias("file_size_bytes"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(~ok, F.concat(F.lit("cannot decode "), F.coalesce("format", F.lit("unknown format")))).alias("error"),
    )
    known = ids.select(F.col("id").alias("_id")).distinct().withColumn("in_dataset", F.lit(True))
    return conform(rows.join(known, F.col("id") == F.col("_id"), "left").withColumn("in_dataset", F.coalesce("in_dataset", F.lit(False))), IMAGES)


def _dct(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def _lanczos(src: int, dst: int, lobes: int = 3) -> np.ndarray:
    """Weights, dst by src, of a windowed sinc that is widened to cover what a target pixel stands for."""
    scale = max(src / dst, 1.0)
    centre = (np.arange(dst) + 0.5) * src / dst
    x = (np.arange(src)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def shrink(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """gray at another size, rounded to whole levels after each direction, rows first."""
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    return level(_lanczos(gray.shape[0], height) @ level(gray @ _lanczos(gray.shape[1], width).T))


#: An image as it should be seen, by the orientation that its camera noted.
TURNS: dict[int, Callable[[np.ndarray], np.ndarray]] = {
    1: lambda a: a,
    2: lambda a: a[:, ::-1],
    3: lambda a: a[::-1, ::-1],
    4: lambda a: a[::-1],
    5: lambda a: a.T,
    6: lambda a: np.rot90(a, -1),
    7: lambda a: a[::-1, ::-1].T,
    8: lambda a: np.rot90(a),
}


def orientation(head: bytes) -> int:
    """1 to 8 from the Exif part of a JPEG's first bytes; 1 where there is none."""
    at = 2
    while head[:2] == b"\xff\xd8" and at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] != 0xDA:
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if head[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
            if order is None or len(tiff) < 8:
                return 1
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)
            first = number(4, 4)
            for entry in range(first + 2, first + 2 + 12 * number(first, 2), 12):
                if number(entry, 2) == 0x0112:
                    return number(entry + 8, 2) if number(entry + 8, 2) in TURNS else 1
            return 1
        at += 2 + size
    return 1


def phash(gray: np.ndarray) -> str:
    """64 bits: low frequencies of a 32 x 32 cosine transform above their median."""
    return _phash_of(shrink(gray, 32, 32))


def _phash_of(small: np.ndarray) -> str:
    m = _dct(32)
    low = (m @ small @ m.T)[:8, :8].ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def dhash(gray: np.ndarray) -> str:
    """64 bits: whether each pixel of an 8 x 9 image is darker than its right neighbour."""
    return _dhash_of(shrink(gray, 8, 9))


def _dhash_of(small: np.ndarray) -> str:
    return np.packbits((small[:, 1:] > small[:, :-1]).ravel()).tobytes().hex()


def turned_hashes(gray: np.ndarray) -> list[tuple[str, str]]:
    """(pHash, dHash) of the image in each of its eight orientations: it is shrunk first, then turned."""
    square, wide, tall = shrink(gray, 32, 32), shrink(gray, 8, 9), shrink(gray, 9, 8)
    return [(_phash_of(turn(square)), _dhash_of(turn(wide if k < 5 else tall))) for k, turn in TURNS.items()]


def gray_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of pixels in blue, green, red order, in whole levels."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
    return (x[..., 0] if channels == 1 else (x[..., :3] @ np.array([7471, 38470, 19595]) + 32768 >> 16)).astype(float)


def _hashes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for r in part.itertuples():
            try:
                all_turns = turned_hashes(gray_of(r.data, r.height, r.width, r.channels))
                out.append((r.origin, [p for p, _ in all_turns], [d for _, d in all_turns], None))
            except Exception as e:  # noqa: BLE001  a bad file is a row, not an end
                out.append((r.origin, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=["origin", "phashes", "dhashes", "problem"])


@F.pandas_udf(T.IntegerType())
def _orientation_of(heads: pd.Series) -> pd.Series:
    return heads.map(lambda h: orientation(bytes(h)))


def hash_images(spark: SparkSession, root: str, images: DataFrame) -> DataFrame:
    """IMAGE_HASHES of the images in the dataset that were read and have id and index.

    Hashes are of the image as its camera's orientation turns it.  Pixels stay in the task that decodes them: it works out
    the hashes of all eight orientations, and the one that the file's first bytes name is picked when both meet by path.
    """
    opts = {"recursiveFileLookup": "true"}
    wanted = images.filter("in_dataset and status = 'ok' and id is not null and image_index is not null")
    shown = spark.read.format("image").options(dropInvalid="true", **opts).load(root)
    shown = shown.select(F.col("image.origin").alias("origin"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    got = shown.mapInPandas(_hashes, "origin string, phashes array<string>, dhashes array<string>, problem string")
    files = spark.read.format("binaryFile").options(**opts).load(root).select("path", F.sha2("content", 256).alias("file_sha256"), _orientation_of(F.expr("substring(content, 1, 131072)")).alias("turn"))
    base = root.removeprefix("file://").rstrip("/") + "/"
    both = files.join(got, _place("path") == _place("origin")).withColumn("relative_path", F.element_at(F.split(F.col("path"), F.lit(rf"\Q{base}\E")), -1)).drop("path", "origin")
    both = both.withColumns({"phash": F.col("phashes")[F.col("turn") - 1], "dhash": F.col("dhashes")[F.col("turn") - 1]})
    rows = wanted.select("id", "image_index", "relative_path", "width", "height").join(both, "relative_path", "left")
    ok = F.col("phash").isNotNull()
    return conform(rows.withColumns({"status": F.when(ok, "ok").otherwise("error"), "error": F.when(~ok, F.coalesce("problem", F.lit("not decoded")))}), IMAGE_HASHES)


def file_digest(path: str, step: int = 1 << 20) -> str:
    """SHA-256 of a local file, read in pieces."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(step):
            digest.update(piece)
    return digest.hexdigest()


def validate_ids(ids: DataFrame) -> None:
    """Product ids: integers from 0, none null, none twice."""
    problems = [f"ids are {dict(ids.dtypes)['id']}"] if dict(ids.dtypes)["id"] not in ("bigint", "int") else []
    if not problems:
        problems = [f"{name}: {n}" for name, n in violations(ids, {"null": F.col("id").isNull(), "negative": F.col("id") < 0}).items()]
        problems += [f"{n} repeat" for n in [repeated(ids, ["id"])] if n]
    demand(problems, "dataset ids")


def validate_images(images: DataFrame, ids: DataFrame) -> None:
    check_schema(images, IMAGES, "images")
    known = images.join(ids.select(F.col("id").alias("_id")).distinct().withColumn("known", F.lit(True)), F.col("id") == F.col("_id"), "left")
    rules = {
        "unknown status": ~F.col("status").isin("ok", "error"),
        "in_dataset differs from ids": F.col("in_dataset") != F.coalesce("known", F.lit(False)),
        "ok without size": (F.col("status") == "ok") & F.expr("format is null or mode is null or not coalesce(width > 0 and height > 0 and file_size_bytes > 0, false)"),
        "error without text": (F.col("status") == "error") & F.col("error").isNull(),
    }
    problems = [f"{name}: {n}" for name, n in violations(known, rules).items()]
    if repeated(images, ["relative_path"]):
        problems.append("paths repeat")
    demand(problems, "images")


def coverage(images: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of counts: items, files, readable, unreadable, items with files and with readable ones, gaps, odd paths, repeated slots."""
    own = ids.select("id").distinct()
    per = images.groupBy("id").agg(F.count("*").alias("files"), F.count_if(F.expr("status = 'ok'")).alias("ok"))
    met = own.withColumn("mine", F.lit(True)).join(per.filter("id is not null"), "id", "full")
    mine, files = F.coalesce("mine", F.lit(False)), F.coalesce("files", F.lit(0))
    products = met.agg(
        F.count_if(mine).alias("dataset_items"),
        F.count_if(mine & (files > 0)).alias("items_with_files"),
        F.count_if(mine & (F.coalesce("ok", F.lit(0)) > 0)).alias("items_with_readable_files"),
        F.count_if(mine & (files == 0)).alias("missing_ids"),
        F.count_if(mine & (F.coalesce("ok", F.lit(0)) == 0)).alias("ids_without_readable_files"),
        F.count_if(~mine).alias("orphan_ids"),
        F.coalesce(F.sum(F.when(~mine, files)), F.lit(0)).alias("orphan_files"),
    )
    rows = images.agg(
        F.count("*").alias("image_files"), F.count_if(F.expr("status = 'ok'")).alias("readable_files"), F.count_if(F.expr("status = 'error'")).alias("unreadable_files"),
        F.count_if(F.expr("id is null")).alias("invalid_id_paths"), F.count_if(F.expr("image_index is null")).alias("invalid_image_indices"),
    )
    slots = duplicate_slots(images).agg(F.count("*").alias("duplicate_slots"))
    return products.crossJoin(rows).crossJoin(slots)  # one row each


def duplicate_slots(images: DataFrame) -> DataFrame:
    """(id, image_index, files) held by several files."""
    return images.filter("id is not null and image_index is not null").groupBy("id", "image_index").agg(F.count("*").alias("files")).filter("files > 1")


def missing_ids(ids: DataFrame, images: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(images.select("id"), "id", "left_anti")


def orphan_ids(ids: DataFrame, images: DataFrame) -> DataFrame:
    return images.filter("id is not null").select("id").distinct().join(ids.select("id"), "id", "left_anti")


def top_sizes(images: DataFrame, n: int = 12) -> DataFrame:
    """A report: the n most frequent sizes in pixels."""
    return images.filter("status = 'ok'").groupBy("width", "height").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "width", "height").limit(n)
