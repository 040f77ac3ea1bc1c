"""The tables that operators pass to each other, and a check of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

NEIGHBOUR = "struct<nbr:bigint,weight:double,feat:string>"

TABLES = {
    "edges": "src string, dst string, weight double",
    "features": "node string, feat string",
    "padded": "src string, src_feat string, dst string, dst_feat string, weight double",
    "node2id": "node string, id bigint",
    "node2feat": "node string, feat string",
    "indexed_edges": "src_id bigint, dst_id bigint, src_feat string, dst_feat string, weight double",
    "adj_edges": "id bigint, nbr bigint, weight double, feat string",
    "adj": f"id bigint, nbrs array<{NEIGHBOUR}>",
    "walks": "walk_no int, start bigint, path array<bigint>, feats array<string>",
    "corpus": "tokens array<string>",
    "vectors": "word string, vector array<float>",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def expect(df: DataFrame, table: str) -> DataFrame:
    """Return the table's columns of ``df`` in order; raise if one is missing or has another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [
        f"{f.name}: need {f.dataType.simpleString()}, have {have.get(f.name, 'nothing')}"
        for f in schema(table).fields
        if have.get(f.name) != f.dataType.simpleString()
    ]
    if wrong:
        raise TypeError(f"not a {table} table: " + "; ".join(wrong))
    return df.select(*schema(table).fieldNames())
