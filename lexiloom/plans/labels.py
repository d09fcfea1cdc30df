"""Labels in three languages, and templates filled from columns."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiloom.core.tables import literal_rows

# The labels of the report and its progress, by key, for zh, en and ja.
LABELS = {
    "metric_combined": ("綜合相似度", "Combined Score", "総合スコア"),
    "metric_tfidf": ("TF-IDF 相似度", "TF-IDF Score", "TF-IDF スコア"),
    "metric_ngram": ("N-gram 指紋", "N-gram Fingerprint", "N-gram フィンガープリント"),
    "metric_keyword": ("關鍵字重疊", "Keyword Overlap", "キーワード重複"),
    "metric_total": ("比對論文數", "Papers Compared", "比較論文数"),
    "risk_high": ("高風險", "High Risk", "高リスク"),
    "risk_medium": ("中風險", "Medium Risk", "中リスク"),
    "risk_low": ("低風險", "Low Risk", "低リスク"),
    "metric_high": ("🔴 高風險", "🔴 High Risk", "🔴 高リスク"),
    "metric_medium": ("🟡 中風險", "🟡 Medium Risk", "🟡 中リスク"),
    "metric_low": ("🟢 低風險", "🟢 Low Risk", "🟢 低リスク"),
    "unknown": ("未知", "Unknown", "不明"),
    "label_author": ("**作者：**", "**Authors:**", "**著者：**"),
    "label_year": ("**年份：**", "**Year:**", "**年：**"),
    "label_link": ("**連結：**", "**Link:**", "**リンク：**"),
    "label_abstract2": ("**摘要：**", "**Abstract:**", "**要旨：**"),
    "label_keywords2": ("**匹配關鍵字：**", "**Matched keywords:**", "**一致キーワード：**"),
    "label_source": ("**來源：**", "**Source:**", "**ソース：**"),
    "label_risk": ("風險等級：", "Risk level: ", "リスクレベル："),
    "parse_src_grobid": ("GROBID（機器學習，最精確）", "GROBID (ML-based, most accurate)", "GROBID（機械学習、最高精度）"),
    "parse_src_layout": ("字型大小分析", "Font-size layout analysis", "フォントサイズ解析"),
    "parse_src_regex": ("正規表示式（備用）", "Regex heuristics (fallback)", "正規表現（フォールバック）"),
    "progress_fmt": ("{source}：已取得 {count} 筆，整體進度 {pct:.0f}%", "{source}: {count} results · Overall {pct:.0f}%", "{source}：{count} 件取得 · 全体 {pct:.0f}%"),
    "expander_result": ("{icon} [{i}] {title} — 相似度 {score:.1f}%", "{icon} [{i}] {title} — Similarity {score:.1f}%", "{icon} [{i}] {title} — 類似度 {score:.1f}%"),
    "para_source": ("你的論文（第 {n} 段）", "Your paper (paragraph {n})", "あなたの論文（第 {n} 段落）"),
    "para_overlap": ("指紋重疊", "Fingerprint overlap", "フィンガープリント重複"),
    "para_candidate": ("對方論文對應片段：", "Matching passage from candidate:", "候補論文の対応箇所："),
    "no_results": ("✅ 未發現相似度高於 {threshold}% 的論文！", "✅ No papers found with similarity above {threshold}%!", "✅ 類似度 {threshold}% 以上の論文は見つかりませんでした！"),
}
LANGUAGES, DEFAULT = ("zh", "en", "ja"), "zh"


def labels(spark: SparkSession) -> DataFrame:
    """``key, lang, template``: a fixed, small table."""
    rows = [(k, lang, t) for k, own in LABELS.items() for lang, t in zip(LANGUAGES, own, strict=True)]
    return literal_rows(spark, rows, "key string, lang string, template string")


def label(key: str, lang: str) -> str:
    """One label: an unknown language is the default one, an unknown key itself."""
    own = LABELS.get(key)
    return own[LANGUAGES.index(lang if lang in LANGUAGES else DEFAULT)] if own else key


def filled(key: str, lang: str, **columns: Column) -> Column:
    """A label whose places are filled from columns; ``.0f`` and ``.1f`` places take numbers."""
    parts = []
    for literal, name, kind, _ in string.Formatter().parse(label(key, lang)):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.format_string(f"%{kind}", columns[name].cast("double")) if kind else columns[name].cast("string"))
    return F.concat(*parts)


def translated(asked: DataFrame, table: DataFrame) -> DataFrame:
    """``asked(key, lang)`` with ``label``, by the rules of :func:`label`."""
    own = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise(F.lit(DEFAULT))
    return (
        asked.withColumn("_own", own)
        .join(F.broadcast(table.select(F.col("key").alias("_k"), F.col("lang").alias("_l"), "template")), (F.col("key") == F.col("_k")) & (F.col("_own") == F.col("_l")), "left")
        .select(*asked.columns, F.coalesce("template", "key").alias("label"))
    )
