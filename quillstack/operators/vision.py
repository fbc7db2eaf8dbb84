"""Table reading by a vision model: requests, responses, follow-up waves. The model is an interface; offline ones work the same."""

from __future__ import annotations

import json
import re
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())
_FIELDS = (("headers", TEXTS), ("rows", T.ArrayType(TEXTS)), ("footnotes", T.StringType()), ("table_label", T.StringType()), ("caption", T.StringType()), ("is_incomplete", T.BooleanType()), ("incomplete_reason", T.StringType()), ("parse_success", T.BooleanType()), ("recrop_needed", T.BooleanType()), ("recrop_bbox_pct", T.ArrayType(T.DoubleType())))
RESPONSE = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
WARNING = "The text below may be garbled: letters and digits can be trusted, symbols and Greek letters should be read from the image."


class VisionModel(Protocol):
    """Answers requests; shipped to the executors."""

    def answer(self, requests: list[dict]) -> list[str | None]: ...


def parse_response(text: str | None) -> dict:
    """A model's answer as a table; an answer that holds none gives an empty one marked as failed."""
    failed = {"headers": [], "rows": [], "footnotes": "", "table_label": None, "caption": "", "is_incomplete": False, "incomplete_reason": "", "parse_success": False, "recrop_needed": False, "recrop_bbox_pct": None}
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "")
    for candidate in (body, body[body.find("{") : body.rfind("}") + 1]):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            break
    else:
        return failed
    headers, rows, recrop = found.get("headers"), found.get("rows"), found.get("recrop") or {}
    if not isinstance(headers, list) or not isinstance(rows, list) or not all(isinstance(r, list) for r in rows) or not isinstance(recrop, dict):
        return failed
    box = recrop.get("bbox_pct")
    good_box = isinstance(box, list) and len(box) == 4 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in box)
    label = found.get("table_label")
    return {
        "headers": [str(h) for h in headers], "rows": [[str(c) for c in r] for r in rows], "footnotes": str(found.get("footnotes", "")), "table_label": label if isinstance(label, str) else None,
        "caption": str(found.get("caption", "")), "is_incomplete": bool(found.get("is_incomplete", False)), "incomplete_reason": str(found.get("incomplete_reason", "")), "parse_success": True,
        "recrop_needed": bool(recrop.get("needed", False)), "recrop_bbox_pct": [float(v) for v in box] if good_box else None,
    }


@F.pandas_udf(RESPONSE)
def parsed_response(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_response(t) for t in text])


def prompt_context(raw_text: Column, caption: Column, garbled: Column) -> Column:
    """What a request says beside the image."""
    return F.concat_ws("\n\n", F.when(garbled, F.lit(WARNING)), F.concat(F.lit("## Raw extracted text\n\n"), F.coalesce(raw_text, F.lit(""))), F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("## Caption\n\n"), caption)))


def ask(requests: DataFrame, model: VisionModel) -> DataFrame:
    """``response`` of each request (request_id and whatever the model reads). A request that fails or gets no answer is a failed table."""
    names = requests.columns

    def batches(parts):
        for pdf in parts:
            rows = pdf.to_dict("records")
            try:
                answers = model.answer(rows)
            except Exception:  # one bad batch must not lose the others
                answers = [None] * len(rows)
            yield pdf.assign(answer=(list(answers) + [None] * len(rows))[: len(rows)])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", answer string"
    return requests.mapInPandas(batches, shape).select(*names, parsed_response("answer").alias("response"))


def has_content(r: Column) -> Column:
    return r["parse_success"] & ((F.size(r["headers"]) > 0) | (F.size(r["rows"]) > 0))


def waves(requests: DataFrame, model: VisionModel) -> DataFrame:
    """(request_id, wave, response): first reading, a second one of the region the model asked for, and a full page where it was incomplete.

    A full page with content wins over a recrop, a complete recrop over the first reading. Requests carry request_id and scope.
    """
    first = ask(requests.withColumn("scope", F.lit("crop")), model)
    again = first.where("response.recrop_needed and response.recrop_bbox_pct is not null").select(*[c for c in requests.columns if c != "scope"], F.lit("recrop").alias("scope"))
    page = first.where("response.is_incomplete or not response.parse_success").select(*[c for c in requests.columns if c != "scope"], F.lit("page").alias("scope"))
    second = ask(again, model).select("request_id", F.col("response").alias("recropped"))
    third = ask(page, model).select("request_id", F.col("response").alias("paged"))
    all_ = first.select("request_id", "response").join(second, "request_id", "left").join(third, "request_id", "left")
    by_page = F.coalesce(has_content(F.col("paged")), F.lit(False))
    by_crop = F.coalesce(F.col("recropped.parse_success") & ~F.col("recropped.is_incomplete"), F.lit(False))
    wave = F.when(by_page, "page").when(by_crop, "recrop").otherwise("crop")
    chosen = F.when(by_page, F.col("paged")).when(by_crop, F.col("recropped")).otherwise(F.col("response"))
    return all_.select("request_id", wave.alias("wave"), chosen.alias("response"))


def cost_id(request_id: Column) -> Column:
    """(table_id, agent_role) of a request id whose last part after '__' is the role."""
    parts = F.split(request_id, "__")
    return F.struct(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), "__").alias("table_id"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("").alias("agent_role"))
