"""Local and repository files: scanning, selection, hashing, resuming, document texts, archives."""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import io
import os
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import doc_id

#: Media types by suffix.
MEDIA_TYPES = {
    "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
ITEM_BYTES, MAX_ITEMS = 20 << 20, 1000


def media_type(path: Column) -> Column:
    """Media type by suffix; a README without one is text; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, suffix), F.when(F.substring_index(path, "/", -1) == "README", F.lit("text/plain")))


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Whether the path or its last part matches one of the globs (with case)."""
    name, out = F.substring_index(path, "/", -1), F.lit(False)
    for p in patterns:
        r = "^" + fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$")
        out = out | path.rlike(r) | name.rlike(r)
    return out


def _matcher(pattern: str):
    return lambda x: x.rlike(pattern)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Directory patterns (ending in ``/``) match a whole part, others any part as a glob."""
    parts, out = F.split(path, "/"), F.lit(False)
    for p in patterns:
        r = "^" + fnmatch.translate(p.rstrip("/")).replace(r"\Z", "$").replace(r"\z", "$")
        hay = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))) if p.endswith("/") else parts
        out = out | F.exists(hay, _matcher(r))
    return out


def _passed_over(spark: SparkSession, root: str) -> tuple[list[tuple[str, int]], list[str]]:
    """Files that Spark's listing hides, with their sizes, and links of a local tree (Spark would follow them)."""
    odd = lambda name: (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    start = fs.makeQualified(base)
    hidden: list[tuple[str, int]] = []
    if start.toUri().getScheme() == "file":
        links, top = [], start.toUri().getPath()
        for folder, folders, names in os.walk(top):
            links += [f"{folder}/{n}" for n in (*folders, *names) if os.path.islink(f"{folder}/{n}")]
            folders[:] = [n for n in folders if not n.startswith(".")]
            below = any(odd(part) for part in os.path.relpath(folder, top).split(os.sep))
            hidden += [(f"file:{folder}/{n}", os.path.getsize(f"{folder}/{n}")) for n in names if (below or odd(n)) and not n.startswith(".") and not os.path.islink(f"{folder}/{n}")]
        return hidden, [f"file:{x}" for x in links]
    todo = [(start, False)]
    while todo:
        folder, below = todo.pop()
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("."):
                continue
            if status.isDirectory():
                todo.append((status.getPath(), below or odd(name)))
            elif below or odd(name):
                hidden.append((status.getPath().toString(), status.getLen()))
    return hidden, []


def listed(spark: SparkSession, root: str, max_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(path, content, length)`` of every file below a root, those with a part that begins with ``_`` too; links aren't followed.

    Spark's own listing passes such files over.  They are found through the file system and read on
    the driver: a few bookkeeping files of a tree (more than ``MAX_ITEMS`` are an error).
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content", "length")
    hidden, links = _passed_over(spark, root)
    for link in links:
        raw = raw.where((F.col("path") != link) & ~F.col("path").startswith(f"{link}/"))
    if not hidden:
        return raw
    if len(hidden) > MAX_ITEMS:
        raise ValueError(f"{len(hidden)} files begin with _, more than {MAX_ITEMS}")
    jvm, rows = spark.sparkContext._jvm, []
    for name, size in hidden:
        path = jvm.org.apache.hadoop.fs.Path(name)
        stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
        try:
            rows.append((name, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)) if size <= max_bytes else None, size))
        finally:
            stream.close()
    return raw.unionByName(spark.createDataFrame(rows, "path string, content binary, length long"))


def scan(spark: SparkSession, root: str, ignore: list[str] = (), after: str | None = None, max_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(rel_path, uri, media_type, content, source_hash)`` of supported files below a root that Spark can list.

    Hidden and ignored paths are left out; ``after`` resumes behind a URI; an oversized file is an error.
    """
    base = root.rstrip("/")
    raw = listed(spark, base, max_bytes)
    rel = F.regexp_replace(F.col("path"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:/*)?/?" + re.escape(re.sub(r"^[a-z]+:/*", "", base).lstrip("/")) + "/", "")
    rows = raw.select(rel.alias("rel_path"), "content", "length").withColumn("media_type", media_type(F.col("rel_path")))
    rows = rows.where(F.col("media_type").isNotNull() & ~F.exists(F.split("rel_path", "/"), lambda p: p.startswith(".")) & ~ignored(F.col("rel_path"), list(ignore)))
    if after is not None:
        rows = rows.where(F.col("rel_path") > after)
    content = F.when(F.col("length") > max_bytes, F.raise_error(F.concat(F.lit("file is too large: "), "rel_path"))).otherwise(F.col("content"))
    return rows.select("rel_path", F.col("rel_path").alias("uri"), "media_type", content.alias("content"), F.sha2("content", 256).alias("source_hash"), doc_id("rel_path").alias("doc_id"))


def capped(df: DataFrame, most: int = MAX_ITEMS) -> DataFrame:
    """The same rows; more than ``most`` is an error, not a cut."""
    if (n := df.count()) > most:
        raise ValueError(f"{n} items exceed the limit of {most}")
    return df


def bundle(spark: SparkSession, root: str) -> DataFrame:
    """``(rel_path, content)`` of every visible file below a root."""
    base = root.rstrip("/")
    raw = listed(spark, base)
    tail = re.sub(r"^[a-z]+:/*", "", base).strip("/")
    rel = F.substring_index(F.col("path"), f"{tail}/", -1)
    return raw.select(rel.alias("rel_path"), "content").where(~F.exists(F.split("rel_path", "/"), lambda p: p.startswith(".")))


def repository(uri: Column) -> Column:
    """``struct<owner, repo, ref>`` of a repository address (https, scp or ssh form), nulls for any other."""
    https = r"^https?://(?:www\.)?github\.com/([^/\s]+)/([^/\s]+?)(?:\.git)?(?:/tree/([^\s]+?))?/?$"
    scp, ssh = r"^git@github\.com:([^/\s]+)/([^/\s]+?)(?:\.git)?()$", r"^ssh://git@github\.com/([^/\s]+)/([^/\s]+?)(?:\.git)?()/?$"
    at = lambda k: F.coalesce(*[F.nullif(F.regexp_extract(uri, p, k), F.lit("")) for p in (https, scp, ssh)])
    return F.struct(at(1).alias("owner"), at(2).alias("repo"), at(3).alias("ref"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes) -> list[dict]:
    """Headings (by style name) and paragraphs of a DOCX file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        m = re.fullmatch(r"[Hh]eading\s*([1-6])", name)
        level = int(m[1]) if m else 1 if name.lower() == "title" else None
        if text:
            out.append({"kind": "heading" if level else "paragraph", "text": text, "level": level, "language": None, "anchor_id": None})
    return out


def pdf_pages(data: bytes) -> list[str]:
    """Page texts of a PDF; needs the optional ``pypdf`` library."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional library pypdf") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


def documents(items: DataFrame) -> DataFrame:
    """``(doc_id, uri, title, blocks)`` of scanned Markdown, text, DOCX and PDF items; a bad file is an error row."""
    from marlstone.sources.markdown import BLOCKS, segment

    def one(kind: str, data: bytes) -> list[dict]:
        if kind == MEDIA_TYPES["docx"]:
            return docx_blocks(data)
        if kind == MEDIA_TYPES["pdf"]:
            return [{"kind": "paragraph", "text": t, "level": None, "language": None, "anchor_id": f"p{n}"} for n, t in enumerate(pdf_pages(data), 1) if t.strip()]
        text = data.decode("utf-8", "replace")
        if kind == MEDIA_TYPES["md"]:
            return segment(text)[0]
        return [{"kind": "paragraph", "text": p.strip("\n"), "level": None, "language": None, "anchor_id": None} for p in re.split(r"\n\s*\n", text) if p.strip()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                try:
                    blocks, error = one(r.media_type, bytes(r.content)), None
                except Exception as e:  # noqa: BLE001
                    blocks, error = [], f"{type(e).__name__}: {e}"
                stem = re.sub(r"[-_]+", " ", r.uri.rsplit("/", 1)[-1].rsplit(".", 1)[0]).strip()
                title = next((x["text"] for x in blocks if x["kind"] == "heading" and x["level"] == 1), stem)
                rows.append((r.doc_id, r.uri, r.source_hash, title, blocks, error))
            yield pd.DataFrame(rows, columns=["doc_id", "uri", "source_hash", "title", "blocks", "error"])

    return items.mapInPandas(run, f"doc_id string, uri string, source_hash string, title string, blocks {BLOCKS}, error string")


# -- archives ---------------------------------------------------------------------------------

def pack(files: DataFrame, path: str, name: str = "bundle") -> str:
    """A byte-reproducible ``tar.gz`` of a small tree with a ``.sha256`` beside it; returns the checksum."""
    with open(path, "wb") as out, gzip.GzipFile(filename="", fileobj=out, mode="wb", mtime=0) as z, tarfile.open(fileobj=z, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for r in files.orderBy("rel_path").select("rel_path", "content").toLocalIterator():
            info = tarfile.TarInfo(f"{name}/{r['rel_path']}")
            info.size, info.mtime, info.mode = len(r["content"]), 0, 0o644
            tar.addfile(info, io.BytesIO(bytes(r["content"])))
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    with open(f"{path}.sha256", "w") as f:
        f.write(f"{digest}  {path.rsplit('/', 1)[-1]}\n")
    return digest


def plain_tree(files: DataFrame) -> DataFrame:
    """A tree whose Markdown files carry only the plain profile's frontmatter; the manifest is left out, for it no longer fits."""
    from marlstone.sources.markdown import rewrite_files

    kept = files.where("rel_path <> 'manifest.json'")
    plain = rewrite_files(kept).select("rel_path", F.col("plain").cast("binary").alias("plain"))
    return kept.join(plain, "rel_path", "left").select("rel_path", F.coalesce("plain", "content").alias("content"))


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """``(rel_path, content)`` of an archive whose checksum file agrees; members outside its root are an error."""
    with open(path, "rb") as f:
        data = f.read()
    with open(f"{path}.sha256") as f:
        if f.read().split()[0] != hashlib.sha256(data).hexdigest():
            raise ValueError(f"checksum mismatch: {path}")
    rows = []
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
        for m in tar.getmembers():
            parts = m.name.split("/")
            if m.name.startswith("/") or ".." in parts or m.issym() or m.islnk():
                raise ValueError(f"unsafe archive member: {m.name}")
            if m.isfile():
                rows.append((m.name, tar.extractfile(m).read()))
    roots = {n.split("/", 1)[0] for n, _ in rows}
    if len(roots) == 1 and all("/" in n for n, _ in rows):
        rows = [(n.split("/", 1)[1], c) for n, c in rows]
    return spark.createDataFrame(rows, "rel_path string, content binary")
