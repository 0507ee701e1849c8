"""Known entities: the names of the entities that are recorded for a document, found in its text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"[^\W\d_]+|\d+")


def compress(name: str) -> str:
    return "".join(c for c in name if c.isalpha() or c.isdigit())


def name_pattern(names: list[str]) -> str:
    """One expression of all names, longest first: as they are, and with anything but letters and digits between their parts where these make up over two thirds of the name."""
    out = []
    for name in sorted(set(names), key=lambda n: (-len(n), n)):
        out.append(rf"\b{re.escape(name)}\b")
        parts = _PART.findall(name)
        if len(compress(name)) / len(name) > 2 / 3 and len(parts) > 1:
            out.append(r"\b" + r"\W*".join(map(re.escape, parts)) + r"\b")
    return "|".join(dict.fromkeys(out))


def find_entities(text: str, names: dict[tuple[str, str, str], list[str]]) -> list[tuple[int, int, tuple[str, str, str]]]:
    """(begin, end, entity) of the names of each entity (type, namespace, id).

    First by case; the entities found no oftener than a tenth of the mean count are looked for again without it.
    """
    found: set[tuple[int, int, tuple[str, str, str]]] = set()

    def search(wanted: dict, flags: int) -> None:
        key = (lambda s: s.lower()) if flags else (lambda s: s)
        by: dict[str, set] = {}
        for e, own in wanted.items():
            for n in own:
                by.setdefault(key(n), set()).add(e)
                by.setdefault(key(compress(n)), set()).add(e)
        every = [n for own in wanted.values() for n in own if n]
        if every:
            for m in re.finditer(name_pattern(every), text, flags):
                hits = by.get(key(m[0])) or by.get(key(compress(m[0]))) or ()
                found.update((m.start(), m.end(), e) for e in hits)

    search(names, 0)
    n = {e: sum(x[2] == e for x in found) for e in names}
    bar = sum(n.values()) // max(len(n), 1) // 10
    search({e: own for e, own in names.items() if n[e] <= bar}, re.I)
    return sorted(found)


def known_entities(docs: DataFrame, entities: DataFrame, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, begin, end, match, identifier, namespace, id): mentions of the entities (key, type, namespace, id) by names (namespace, id, name).

    identifier is the entity's type. A document's names come to it by two joins; documents without entities or names have none.
    """
    per = entities.join(names.distinct(), ["namespace", "id"]).where("name <> ''").groupBy(key, "type", "namespace", "id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    per = per.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("type", "namespace", "id", "names")).alias("entities"))
    own = docs.join(per, docs[key] == F.col("_k")).select(key, "text", "entities")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                for b, e, (kind, ns, i) in find_entities(text or "", {(w["type"], w["namespace"], w["id"]): w["names"] for w in wanted}):
                    rows.append((k, b, e, text[b:e], kind, ns, i))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.int32(), pa.int32(), *[pa.string()] * 4))], [key, "begin", "end", "match", "identifier", "namespace", "id"])

    return own.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, begin int, end int, match string, identifier string, namespace string, id string")
