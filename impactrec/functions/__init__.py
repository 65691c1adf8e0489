from impactrec.functions.expressions import flag, indicator, is_missing, key_bucket, scores_array, slot
from impactrec.functions.ordering import following_rows, running_totals

__all__ = ["flag", "following_rows", "indicator", "is_missing", "key_bucket", "running_totals", "scores_array", "slot"]
