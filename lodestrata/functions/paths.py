"""Vault-relative paths, directory scopes and file kinds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds by suffix.
SOURCE_KINDS = {"md": "markdown", "markdown": "markdown", "txt": "text", "pdf": "pdf", "doc": "doc", "dot": "doc", "docx": "docx", "xls": "xls", "xlsx": "xlsx", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image"}
PREVIEW_KINDS = {"pdf": ["pdf"], "image": ["png", "jpg", "jpeg", "gif", "webp", "bmp", "svg"], "markdown": ["md", "markdown"], "text": ["txt", "csv", "json", "log"], "office": ["doc", "docx", "xls", "xlsx", "ppt", "pptx"]}
# End of fixed values.


def parts(path: Column) -> Column:
    return F.filter(F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))


def normal_path(path: Column) -> Column:
    """Lower-case relative path with plain slashes; null for absolute, drive, empty or climbing paths."""
    plain = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    bad = (plain == "") | plain.startswith("/") | plain.rlike("^[A-Za-z]:") | F.array_contains(parts(path), "..") | (F.size(parts(path)) == 0)
    return F.when(~bad, F.lower(F.array_join(parts(path), "/")))


def under(path: Column, scope: Column) -> Column:
    """Whether a path is the scope or lies below it."""
    return (path == scope) | path.startswith(F.concat(scope, F.lit("/")))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def source_kind(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in SOURCE_KINDS.items() for x in kv])
    return F.coalesce(kinds[suffix(path)], F.lit("unsupported"))


def preview_kind(path: Column) -> Column:
    out = None
    for kind, ends in PREVIEW_KINDS.items():
        out = F.when(suffix(path).isin(ends), kind) if out is None else out.when(suffix(path).isin(ends), kind)
    return out.otherwise("download")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def holds_absolute_path(text: Column) -> Column:
    from lodestrata.functions.text import ABSOLUTE_PATH

    return text.rlike(ABSOLUTE_PATH)
