"""Prediction rows and the block / pass decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.answers import parse_answer_any
from mailsift.functions.text import label_word, strip_ws

# Risk score, level and action of each outcome; the strict and the lenient
# outcome are those of an answer that names neither class.
OUTCOMES = {
    "blank": (0.0, "NONE", "ERROR"),
    "phishing": (1.0, "HIGH", "BLOCK"),
    "legitimate": (0.0, "LOW", "PASS"),
    "strict": (0.5, "UNKNOWN", "BLOCK"),
    "lenient": (0.5, "UNKNOWN", "PASS"),
}
STRICT_UP_TO = 0.5

REASONS = {
    "blank": "no mail text was given",
    "phishing": "the model takes the mail for phishing; it is blocked",
    "legitimate": "the model sees no sign of phishing; it is delivered",
    "strict": "no usable answer, and the strict threshold blocks such mail",
    "lenient": "no usable answer, and the lenient threshold delivers such mail",
}

# What the operator's screen shows: level, action and details. {answer} is
# the model's answer, {threshold} the chosen threshold.
DISPLAY = {
    "blank": ("無", "⚠️ 錯誤", "請先輸入測試文本（主旨或內文）"),
    "phishing": (
        "HIGH (高風險)",
        "🚨 攔截並發出警報 (BLOCK) —— 專屬模型判定為 Phishing 威脅",
        "【模型偵測結果】: {answer}\n【資安決策】: 模型認定此郵件包含高度商業郵件詐騙 (BEC) 特徵，系統已強制阻斷。",
    ),
    "legitimate": (
        "LOW (低風險)",
        "🟢 安全放行 (PASS) —— 專屬模型判定為 Legitimate 安全",
        "【模型偵測結果】: {answer}\n【資安決策】: 模型評估此郵件無可疑社交工程特徵，准予放行至員工收件匣。",
    ),
    "strict": (
        "UNKNOWN (無法辨識)",
        "🚨 攔截控制 (BLOCK) —— 模型輸出異常({answer})，依防禦政策強制阻斷！",
        "【異常處理】: 模型無法給出明確標籤。因為網頁端設定的門檻為 {threshold} (屬嚴格政策)，資安系統採取『寧可錯殺』方針。",
    ),
    "lenient": (
        "UNKNOWN (無法辨識)",
        "🟢 異常放行 (PASS) —— 模型輸出異常({answer})，依防禦政策容忍放行。",
        "【異常處理】: 模型無法給出明確標籤。因為網頁端設定的門檻為 {threshold} (屬寬鬆政策)，系統選擇放行。",
    ),
}


def prediction_rows(
    df: DataFrame, answer: str = "raw_prediction", parse=parse_answer_any, index: str = "index"
) -> DataFrame:
    """Expected word, parsed label and correctness of each answer; invalid is never correct."""
    parsed = df.withColumn("predicted_label", parse(F.col(answer)))
    return parsed.select(
        index,
        "dataset",
        "subject",
        "label",
        label_word(F.col("label")).alias("expected"),
        F.col(answer).alias("raw_prediction"),
        "predicted_label",
        F.coalesce(F.col("predicted_label") == F.col("label"), F.lit(False)).alias("correct"),
    )


def _outcome(mail: Column, answer: Column, threshold: float) -> Column:
    unusable = "strict" if threshold <= STRICT_UP_TO else "lenient"
    label = parse_answer_any(answer)
    return (
        F.when(F.coalesce(strip_ws(mail), F.lit("")) == "", "blank")
        .when(label == 1, "phishing")
        .when(label == 0, "legitimate")
        .otherwise(unusable)
    )


def gate(
    df: DataFrame,
    threshold: float = 0.5,
    mail: str = "email_text",
    answer: str = "raw_prediction",
    display: bool = False,
) -> DataFrame:
    """Decide on each mail. A pure projection, so it serves batches and streams alike.

    ``display`` adds the texts of the operator's screen.
    """
    response = F.lower(strip_ws(F.coalesce(F.col(answer), F.lit(""))))
    decided = df.withColumn("__outcome", _outcome(F.col(mail), F.col(answer), threshold))
    outcome = F.col("__outcome")

    def pick(values: dict) -> Column:
        chosen = F.lit(None)
        for name, value in values.items():
            chosen = F.when(outcome == name, value).otherwise(chosen)
        return chosen

    columns = {
        "response": F.when(outcome != "blank", response),
        "risk_score": pick({k: F.lit(v[0]) for k, v in OUTCOMES.items()}),
        "risk_level": pick({k: F.lit(v[1]) for k, v in OUTCOMES.items()}),
        "action": pick({k: F.lit(v[2]) for k, v in OUTCOMES.items()}),
        "reason": pick({k: F.lit(v) for k, v in REASONS.items()}),
    }
    if display:
        for i, name in enumerate(("shown_level", "shown_action", "shown_details")):
            texts = {k: F.lit(v[i].replace("{threshold}", str(threshold))) for k, v in DISPLAY.items()}
            columns[name] = F.replace(pick(texts), F.lit("{answer}"), response)
    return decided.withColumns(columns).drop("__outcome")
