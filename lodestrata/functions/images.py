"""Local images that a Markdown text embeds: where they stand, what they name, and the text with other targets."""

from __future__ import annotations

import posixpath
import re
from itertools import accumulate
from pathlib import PurePosixPath
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two ways to embed, fences, remote targets, and the endings of images.
EMBED = re.compile(r"!\[\[(?P<wiki>[^\]|]+)(?:\|(?P<label>[^\]]*))?\]\]|!\[(?P<alt>[^\]]*)\]\((?P<link>[^)\s]+)(?:\s+[^)]*)?\)")
FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
REMOTE = re.compile(r"(?:[a-z][a-z0-9+.-]*:|//)", re.I)
ENDINGS = {".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".avif", ".heic", ".tif", ".tiff"}
# End of fixed values.

REFERENCE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("alt", T.StringType()), T.StructField("syntax", T.StringType())])
FOUND = T.StructType([T.StructField("images", T.ArrayType(REFERENCE)), T.StructField("issue", T.StringType())])


class Outside(ValueError):
    """A local image without a path, or with one that leaves the root."""


def _inside(path: str) -> str:
    parts = PurePosixPath(path.replace("\\", "/").lstrip("/"))
    if not parts.parts or ".." in parts.parts:
        raise Outside("an image must stay inside the root")
    return str(parts)


def _beside(folder: str, target: str) -> str:
    """A target relative to a folder, as a path from the root."""
    if target.startswith("/") or target[1:2] == ":":
        raise Outside("an image must stay inside the root")
    path = posixpath.normpath(f"{folder}/./{target}".replace("\\", "/").lstrip("/"))
    return _inside("" if path == "." else path)


def find_images(text: str, path: str) -> list[dict]:
    """Local images outside fences, in order, with their places in the text."""
    folder, fence, out = posixpath.dirname(path), "", []
    lines = text.splitlines(keepends=True)
    for line, at in zip(lines, accumulate(map(len, lines), initial=0)):
        if mark := FENCE.match(line):
            fence = "" if fence == mark[1][0] else fence or mark[1][0]
            continue
        for m in EMBED.finditer(line) if not fence else ():
            wiki = m["wiki"] is not None
            target = unquote((m["wiki"] if wiki else m["link"]).strip())
            if not target or REMOTE.match(target):
                continue
            target = target.partition("#")[0].strip()
            if not target:
                raise Outside("an image needs a path")
            source = _inside(target) if wiki else _beside(folder, target)
            if PurePosixPath(source).suffix.lower() in ENDINGS:
                out.append({"start": at + m.start(), "end": at + m.end(), "source": source, "alt": ((m["label"] if wiki else m["alt"]) or "").strip(), "syntax": "wikilink" if wiki else "markdown"})
    return out


#: Texts that a task turns into Python strings at a time.
STEP = 500


def _by_step(one, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``one`` of each row, a few rows at a time, so that a batch of long texts is not held as Python objects."""
    parts = [pa.array([one(*row) for row in zip(*(c.slice(at, STEP).to_pylist() for c in columns))], kind) for at in range(0, len(columns[0]), STEP)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _found(text: str | None, path: str | None) -> dict:
    try:
        return {"images": find_images(text or "", path or ""), "issue": None}
    except Outside as e:
        return {"images": [], "issue": str(e)}


@F.arrow_udf(FOUND)
def image_references(text: pa.Array, path: pa.Array) -> pa.Array:
    """Struct of the images of a text and an issue; a text with an unsafe image has no images and says why."""
    ref = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.string()), ("alt", pa.string()), ("syntax", pa.string())])
    return _by_step(_found, pa.struct([("images", pa.list_(ref)), ("issue", pa.string())]), text, path)


@F.arrow_udf(T.StringType())
def _replaced(text: pa.Array, images: pa.Array) -> pa.Array:
    def one(t: str | None, refs: list[dict] | None) -> str:
        t, refs = t or "", refs or []
        at = [0, *(r["end"] for r in refs)]
        embeds = ["![[" + "|".join(filter(None, (r["target"], r["alt"]))) + "]]" for r in refs] + [""]
        return "".join(t[a : r["start"] if r else len(t)] + e for a, r, e in zip(at, [*refs, None], embeds))

    return _by_step(one, pa.string(), text, images)


def rewrite_images(notes: DataFrame, targets: DataFrame, key: str, text: str = "text", path: str = "relative_path") -> DataFrame:
    """key, text, issue: the notes with each local image embedded by its new target.

    targets: key, source, target. Where an image has no target, or is unsafe, the text
    stays as it is and ``issue`` says why.
    """
    read = notes.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"), image_references(text, path).alias("r"))
    each = read.select(key, F.explode("r.images").alias("i")).withColumn("source", F.col("i.source"))
    given = targets.groupBy(key, "source").agg(F.min("target").alias("target"))
    placed = each.join(given, [key, "source"], "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i.start", "i.end", "i.alt", "target"))).alias("images"), F.min(F.when(F.col("target").isNull(), F.col("source"))).alias("lacks"))
    rows = read.join(placed, key, "left").withColumn("issue", F.coalesce("r.issue", F.concat(F.lit("no target for "), "lacks")))
    new = _replaced("text", F.when(F.col("issue").isNull(), F.col("images")))
    return rows.withColumn("new", new).select(key, F.when(F.col("issue").isNull(), F.col("new")).otherwise(F.col("text")).alias("text"), "issue")
