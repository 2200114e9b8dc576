"""XML documents as one row per element in document order.

``pre`` is the element's place in document order and ``last`` the largest
``pre`` below it, so that "a contains d" is ``d.pre > a.pre AND d.pre <=
a.last`` within a document: containment needs a range join, never recursion.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.sources.decode import decoded

NODE_SCHEMA = "path string, pre int, last int, parent_pre int, depth int, ns string, prefix string, local string, qname string, gml_id string, attrs map<string,string>, text string, tail string, error string"
NAMESPACE_SCHEMA = "path string, nth int, prefix string, uri string"


def _parse(data: bytes) -> tuple[list[dict], list[tuple[str, str]]]:
    rows: list[dict] = []
    stack: list[int] = []
    scopes: list[dict[str, str]] = [{"xml": "http://www.w3.org/XML/1998/namespace"}]
    declared: list[tuple[str, str]] = []
    # Text goes to the element that began last, or, after an element's end, to its tail.
    into: list = [0, "text"]
    said: dict[tuple[int, str], list[str]] = {}

    def start(name: str, attrs: dict) -> None:
        scope = dict(scopes[-1])
        for key, value in attrs.items():
            if key == "xmlns" or key.startswith("xmlns:"):
                prefix = key[6:] or "_default"
                scope[prefix] = value
                declared.append((prefix, value))
        scopes.append(scope)
        prefix, _, local = name.rpartition(":")
        plain = {k: v for k, v in attrs.items() if k != "xmlns" and not k.startswith("xmlns:")}
        rows.append({
            "pre": len(rows), "last": None, "parent_pre": stack[-1] if stack else None, "depth": len(stack), "ns": scope.get(prefix or "_default"), "prefix": prefix, "local": local,
            "qname": name, "gml_id": attrs.get("gml:id") or next((v for k, v in plain.items() if k.endswith(":id") and "/gml" in scope.get(k[:-3], "")), None), "attrs": [*plain.items()], "text": None, "tail": None, "error": None,
        })
        stack.append(len(rows) - 1)
        into[:] = [len(rows) - 1, "text"]

    def end(_: str) -> None:
        at = stack.pop()
        rows[at]["last"] = len(rows) - 1
        into[:] = [at, "tail"]
        scopes.pop()

    def characters(text: str) -> None:
        if stack:
            said.setdefault((into[0], into[1]), []).append(text)

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    parser.Parse(data.lstrip(), True)
    for (at, part), pieces in said.items():
        if (text := "".join(pieces)).strip():
            rows[at][part] = text
    return rows, declared


def _nodes(path: str, data: bytes) -> Iterator[dict]:
    try:
        rows, _ = _parse(data)
    except (expat.ExpatError, ValueError, LookupError) as wrong:
        yield dict.fromkeys(c.split()[0] for c in NODE_SCHEMA.split(", ")) | {"path": path, "error": f"cannot parse: {wrong}"}
        return
    for row in rows:
        yield row | {"path": path}


def _namespaces(path: str, data: bytes) -> Iterator[dict]:
    try:
        _, declared = _parse(data)
    except (expat.ExpatError, ValueError, LookupError):
        return
    for nth, (prefix, uri) in enumerate(declared):
        yield {"path": path, "nth": nth, "prefix": prefix, "uri": uri}


def read_nodes(contents: DataFrame) -> DataFrame:
    """Elements of each document; text stands before an element's first child and tail after the element, null if blank; a document that cannot be parsed is one row with an error."""
    return decoded(contents, _nodes, NODE_SCHEMA)


def read_namespaces(contents: DataFrame) -> DataFrame:
    """One row per document with its prefixes; the last declaration of a prefix counts, ``_default`` is the plain one."""
    rows = decoded(contents, _namespaces, NAMESPACE_SCHEMA)
    last = rows.groupBy("path", "prefix").agg(F.max_by("uri", "nth").alias("uri"))
    return last.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prefix", "uri")))).alias("namespaces"))
