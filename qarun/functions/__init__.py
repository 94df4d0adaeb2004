from qarun.functions.columns import ORDER_BUCKET_BITS, is_blank, is_ok, long_bucket

__all__ = ["ORDER_BUCKET_BITS", "is_blank", "is_ok", "long_bucket"]
