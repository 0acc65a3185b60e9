"""Check of documents against the standards index."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ampertrace.operators import standards as S
from ampertrace.session import cut_lineage


def check_standards(docs: DataFrame, paths: DataFrame, web_prefix: str) -> DataFrame:
    """References of every document with links; prefixes seen in the inventory extend the search."""
    inventory = cut_lineage(S.best_revision(paths, web_prefix))
    refs = cut_lineage(S.document_refs(docs, S.inventory_prefixes(inventory)))
    return S.refs_by_file(refs, S.lookup_inventory(refs, inventory))
