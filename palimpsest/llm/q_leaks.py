"""Problem 9: held-out passages that stand in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.fmindex import MAX_QUERY_WORDS, leaked_spans
from palimpsest.plans.runtime import table


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal spans, in words of the text."""
    items = table(spark, sf_dir, "eval_item").select("item_id", "passage").dropna().limit(MAX_QUERY_WORDS + 1).collect()  # a fixed held-out set; its size is checked
    return leaked_spans(table(spark, sf_dir, "documents"), "doc_id", "text", [(r[0], r[1]) for r in items])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_spans(spark, sf_dir).select("item_id", "doc_id").distinct()


QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans}
_GRAM = ", ".join(f"lead(w, {k}) OVER o" for k in range(1, 13))
# compatibility forms in these texts: ligatures and full-width letters are not told apart by SQL's NFC, so they are spelled out
_FORMS = "replace(replace(replace(replace(replace(nfc_normalize(coalesce({c}, '')), 'ﬃ', 'ffi'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬄ', 'ffl')"
_WORDS = lambda c: f"regexp_extract_all(lower({_FORMS.format(c=c)}), '[\\p{{L}}\\p{{Nd}}\\p{{Nl}}\\p{{No}}]+')"
_RUNS = lambda key, c, t: f"(SELECT DISTINCT {key}, g FROM (SELECT {key}, concat_ws(' ', w, {_GRAM}) AS g, lead(w, 12) OVER o AS last FROM (SELECT {key}, unnest({_WORDS(c)}) AS w, generate_subscripts({_WORDS(c)}, 1) AS n FROM {t}) WINDOW o AS (PARTITION BY {key} ORDER BY n)) WHERE last IS NOT NULL)"
ORACLES: dict[str, str] = {"p9_found": f"SELECT DISTINCT item_id, doc_id FROM {_RUNS('item_id', 'passage', 'eval_item')} JOIN {_RUNS('doc_id', 'text', 'documents')} USING (g)"}
