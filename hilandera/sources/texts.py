"""Text sources: files, texts with document or segment markers, TEI; edits of a document set; lexicons."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hilandera import constants as C
from hilandera.functions.text import trimmed

_LABEL = "[^\\r\\n\\u2028\\u2029]+?"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, label, text: a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_name").alias("label"), F.col("value").alias("text"))


def _parts(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, n (markers), part, label, body: part 0 is what precedes the first marker."""
    marker = f"---{kind}:({_LABEL})---"
    labels = F.regexp_extract_all("text", F.lit(marker), F.lit(1))
    bodies = F.split("text", marker.replace("(", "").replace(")", ""), -1)
    named = F.arrays_zip(bodies.alias("body"), F.concat(F.array(F.lit(C.PREAMBLE)), labels).alias("label"))
    rows = docs.withColumn("n", F.size(labels)).select("doc_id", "n", F.posexplode(named).alias("part", "x"))
    return rows.select("doc_id", "n", F.col("part").cast("bigint").alias("part"), trimmed("x.label").alias("label"), trimmed("x.body").alias("body"))


def split_documents(docs: DataFrame) -> DataFrame:
    """doc_id, part, label, text of the parts behind ---DOC:label--- markers, if there are two or more;
    what precedes them and empty parts go."""
    return _parts(docs, "DOC").filter("n >= 2 and part > 0 and body <> ''").select("doc_id", "part", "label", F.col("body").alias("text"))


def split_segments(docs: DataFrame) -> DataFrame:
    """doc_id, part, label, text of the parts between ---SEG:label--- markers; what precedes the first
    is the preamble; empty parts go."""
    return _parts(docs, "SEG").filter("n >= 1 and body <> ''").select("doc_id", "part", "label", F.col("body").alias("text"))


def without_segment_markers(docs: DataFrame) -> DataFrame:
    """docs with each segment marker replaced by a paragraph break."""
    return docs.withColumn("text", F.regexp_replace("text", f"---SEG:{_LABEL}---", "\n\n"))


def add_document(docs: DataFrame, doc_id, label: str, text: str) -> DataFrame:
    return docs.unionByName(docs.sparkSession.createDataFrame([(doc_id, label, text)], docs.select("doc_id", "label", "text").schema), allowMissingColumns=True)


def remove_document(docs: DataFrame, doc_id) -> DataFrame:
    """docs without one document, but never without the last."""
    n = docs.select("doc_id").limit(2).count()
    return docs.filter(F.col("doc_id") != doc_id) if n > 1 else docs


def update_document(docs: DataFrame, doc_id, **values: str) -> DataFrame:
    """docs with another text or label of one document."""
    return docs.withColumns({k: F.when(F.col("doc_id") == doc_id, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _named(e: ET.Element, name: str, tags: dict[str, set[str]]):
    """e and what is in it by this name, in order; tags: the full names of each name. The parser looks for one."""
    full = tags.get(name, ())
    return e.iter(*full) if len(full) == 1 else (x for x in e.iter() if x.tag in full)


def _inside(e: ET.Element, tags: dict[str, set[str]], *path: str):
    """Elements reached by descending through these names at any depth."""
    if not path:
        yield e
        return
    for x in _named(e, path[0], tags):
        if x is not e:
            yield from _inside(x, tags, *path[1:])


def _paragraph(p: ET.Element) -> str:
    out = [p.text or ""]
    for child in p:
        if _name(child) == "w":
            texts = [child.text or "", *(x.tail or "" for x in child)]
            out.append(next((t.strip() for t in reversed(texts) if t.strip()), ""))
        out.append(child.tail or "")
    return "".join(out).strip()


def parse_tei(xml: str) -> list[tuple[int, str | None, str | None, str | None]]:
    """(part, label, text, error) of each TEI element, or one row with an error."""
    try:
        root = ET.fromstring(xml.encode())
    except ET.ParseError as e:
        return [(0, None, None, f"XML: {e}"[:120])]
    tags: dict[str, set[str]] = {}
    for full in {x.tag for x in root.iter()}:
        tags.setdefault(full.rpartition("}")[2], set()).add(full)
    found = list(_named(root, "TEI", tags))
    if not found:
        return [(0, None, None, "no TEI element")]
    rows = []
    for i, tei in enumerate(found):
        title = next(_inside(tei, tags, "titleStmt", "title"), None)
        label = "".join(title.itertext()) if title is not None else f"Documento {i + 1}"
        seen: dict[int, ET.Element] = {id(p): p for p in _inside(tei, tags, "body", "p")}
        rows.append((i, label, "\n\n".join(map(_paragraph, seen.values())), None))
    return rows


def import_tei(docs: DataFrame) -> DataFrame:
    """doc_id, part, label, text, error of the TEI documents in each text (an XML file)."""
    # row by row, a hundred at a time: texts are long, and an Arrow batch would hold ten thousand of them
    parse = F.udf(lambda t: parse_tei(t or ""), "array<struct<part: bigint, label: string, text: string, error: string>>", useArrow=False)
    return docs.select("doc_id", F.explode(parse("text")).alias("_x")).select("doc_id", "_x.*")
