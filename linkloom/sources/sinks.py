"""Write rendered indexes as text documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.history import latest_per_site


def export_index(files: DataFrame, out: str) -> None:
    """Newest index of each site as text below ``out/site_id=<id>``.

    The writer ends every document with a line end: one that the index has already is
    left out before, so the file is the index byte for byte.
    """
    newest = latest_per_site(files.select("site_id", "id", "created_at", "content"))
    text = F.regexp_replace("content", r"\n\z", "")
    newest.select("site_id", text.alias("value")).write.mode("overwrite").partitionBy("site_id").text(out)
