"""Recursive redaction of JSON text; its depth is open, so it runs in Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys whose values are secrets.
SENSITIVE = {"api_key", "apikey", "authorization", "bearer", "password", "secret", "token", "ocr_api_key", "llm_api_key", "assistant_api_key"}
MASKED_PARTS = ("api_key", "apikey", "authorization", "password", "secret", "token")
MAX_CHARS, MAX_ITEMS = 4000, 50


def redact(value, most: int = MAX_CHARS):
    """Secrets by key, long lists and texts cut, data URLs taken out."""
    if isinstance(value, dict):
        hide = lambda k: (n := str(k).lower().replace("-", "_")) in SENSITIVE or n.endswith("_api_key")
        return {k: "[redacted]" if hide(k) else redact(v, most) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v, most) for v in value[:MAX_ITEMS]]
    if isinstance(value, str):
        if value.startswith("data:") and ";base64," in value[:100]:
            return "[redacted-base64-data-url]"
        return value if len(value) <= most else f"{value[:most]}...[truncated {len(value) - most} chars]"
    return value


def mask(value):
    """Keys that contain a secret's name are starred; flags that only say whether there is one stay."""
    if isinstance(value, dict):
        return {k: "***" if not str(k).lower().startswith("has_") and any(p in str(k).lower() for p in MASKED_PARTS) else mask(v) for k, v in value.items()}
    return [mask(v) for v in value] if isinstance(value, list) else value


def _over(change):
    @F.pandas_udf(T.StringType())
    def run(payload: pd.Series) -> pd.Series:
        def one(text):
            try:
                return json.dumps(change(json.loads(text)), ensure_ascii=False, sort_keys=True) if text is not None else None
            except ValueError:
                return None
        return payload.map(one)
    return run


redact_payload, mask_payload = _over(redact), _over(mask)
