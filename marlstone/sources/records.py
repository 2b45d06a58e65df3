"""Small record sources: conversation logs, project and benchmark specs, manifests, revisions, build caches."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.evaluate import CLASSES

TURN = "type string, role string, text string, citations array<string>, _bad string"


def append_turn(path: str, conv_id: str, role: str, text: str, citations: list[str] = ()) -> None:
    """Adds one turn to a conversation log; a new log begins with its meta line."""
    p = Path(path)
    lines = [] if p.exists() else [{"type": "meta", "id": conv_id}]
    lines.append({"type": "turn", "role": role, "text": text, "citations": list(citations)})
    with p.open("a", encoding="utf-8") as f:
        f.writelines(json.dumps(x, ensure_ascii=False) + "\n" for x in lines)


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """``(conv_id, turn, role, text, citations)`` of logs below a path; malformed lines are passed over.

    Turns are numbered by their place among the log's lines, so numbers rise but may leave gaps.
    """
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("conv_id"), "value")
    return parse_turns(raw.select("conv_id", F.posexplode(F.split("value", "\n")).alias("turn", "line")).where("turn > 0"))


def parse_turns(lines: DataFrame) -> DataFrame:
    """Turns among the JSON ``lines(conv_id, turn, line)`` of conversation logs."""
    parsed = lines.select("conv_id", "turn", F.from_json("line", TURN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("t"))
    return parsed.where("t._bad is null and t.type = 'turn'").select("conv_id", "turn", "t.role", "t.text", "t.citations")


def project(path: str) -> dict:
    """``{name, sources: [{connector, uri, ..}], model, embedder}`` of a project file; a source without a URI is an error."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    head = data.get("project", {})
    sources = data.get("sources", [])
    for s in sources:
        if not isinstance(s, dict) or not s.get("uri"):
            raise ValueError(f"{path}: every source needs a uri")
    return {"name": str(head.get("name", "")).strip() or Path(path).resolve().parent.name, "sources": sources, "model": head.get("model"), "embedder": head.get("embedder")}


def benchmark(spark: SparkSession, path: str) -> tuple[str, dict[str, str], DataFrame]:
    """Name, bundle folders, and ``(id, bundle, class, question, gold)`` of a benchmark spec; a flaw is an error."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    name = str(data.get("benchmark", {}).get("name", "")).strip()
    bundles = {k: str((Path(path).resolve().parent / v).resolve()) for k, v in data.get("bundles", {}).items()}
    flaws = [] if name else ["no name"]
    flaws += [f"no folder {b}" for b in bundles.values() if not Path(b).is_dir()] or ([] if bundles else ["no bundles"])
    rows, seen = [], set()
    for q in data.get("questions", []):
        row = (str(q.get("id", "")).strip(), str(q.get("bundle", "")).strip(), str(q.get("class", "lookup")).strip(), str(q.get("question", "")).strip(), q.get("gold_evidence", []))
        tests = {"a unique id": row[0] and row[0] not in seen, "a known bundle": row[1] in bundles, "a known class": row[2] in CLASSES, "a text": row[3],
                 "gold paths unless it is unanswerable": isinstance(row[4], list) and all(isinstance(g, str) for g in row[4]) and bool(row[4]) == (row[2] != "unanswerable")}
        flaws += [f"question {row[0]!r} needs {t}" for t, ok in tests.items() if not ok]
        seen.add(row[0])
        rows.append(row)
    if flaws or not rows:
        raise ValueError(f"{path}: {'; '.join(flaws or ['no questions'])}")
    return name, bundles, spark.createDataFrame(rows, "id string, bundle string, class string, question string, gold array<string>")


def manifest(files: DataFrame) -> DataFrame:
    """``(rel_path, sha256)`` entries of a bundle's manifest; none if it is missing or of another shape."""
    text = files.where("rel_path = 'manifest.json'").select(F.decode("content", "utf-8").alias("t"))
    entries = F.from_json("t", "files map<string, struct<sha256:string, bytes:bigint>>")
    return text.select(F.explode(entries["files"]).alias("rel_path", "e")).select("rel_path", "e.sha256")


def revisions(spark: SparkSession, folder: str) -> list[str]:
    """Published revisions below a folder, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(m[1] for n in names if (m := re.fullmatch(r"revision_id=(.+)", n)))
