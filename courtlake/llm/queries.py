"""The operators' registered queries: each over its whole table, with production parameters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, crossentropy, decontaminate, jaccard, licenses, linededup, packing, pii, quality, simhash, spelling, toolcalls, whitening
from .common import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judge(decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=4))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near"))


@query("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("row")


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    c = F.col(name)
    return found.select("doc_id", *[c[f].alias(f) for f in ("n_words", "n_base", "first_word", "last_word")], *[F.array_join(c[f], ",").alias(f) for f in ("base_labels", "labels")], c["score"].alias("score"))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, name = quality.judge(table(spark, sf_dir, "documents"), keep_cols=["doc_id"])
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_failed"]
    return judged.select("doc_id", *[F.col(name)[f].alias(f) for f in fields], F.round(F.col(name)["host_rate"], 6).alias("host_rate"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


#: The tools that stand in for the table's own, as it has none.
TOOLS = {
    "search": {"limit": ("BIGINT", True), "text": ("STRING", True)},
    "summarize": {"max_words": ("BIGINT", False), "text": ("STRING", True)},
    "translate": {"lang": ("STRING", True), "text": ("STRING", True)},
}


@query("op5_tool_calls")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn is a call on its whole text, each user turn behind it the result. The tool, its odd fields and
    what a call needs follow from the turn and the length of the text."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").alias("position"), "role", "text")
    size, ident = F.length("text"), lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv").cast("string"), turn.cast("string"))
    name = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.pmod(size, F.lit(3)) + 1).cast("int"))
    fields = F.when(F.pmod(size, F.lit(11)) == 0, F.to_json(F.struct("text", F.lit("ten").alias("limit")))).when(F.pmod(size, F.lit(3)) == 0, F.to_json(F.struct("text", size.alias("limit")))).when(F.pmod(size, F.lit(3)) == 1, F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct("text", F.lit("en").alias("lang"))))
    turn = F.col("position")
    needs = F.when(F.pmod(turn, F.lit(8)) == 3, F.array(ident(turn - 2))).when(F.pmod(turn, F.lit(8)) == 5, F.array(ident(turn + 2))).otherwise(F.array().cast("array<string>"))
    calls = turns.where("role = 'assistant'").select("conv", ident(turn).alias("call_id"), "position", name.alias("name"), fields.alias("arguments"), needs.alias("needs"))
    results = turns.where("role = 'user' and position > 0").select("conv", ident(turn - 1).alias("call_id"), "position", F.col("text").alias("content"))
    return toolcalls.link(calls, results, TOOLS).withColumnsRenamed({"conv": "conv_id", "position": "turn"})


@query("op7_lm_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = crossentropy.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


@query("op8_line_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, removed = linededup.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.col(removed).alias("n_removed"), F.length("text").alias("n_chars"), "text")


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[F.round(c, 6).alias(c) for c in ("d_toxic", "p_toxic", "d_bad", "p_bad")], "toxic", "kept")


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.size(pii.only([k])).cast("long").alias(f"n_{k}") for k in pii.BASE], F.sha2(pii.joined(pii.only(pii.BASE)), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, shown = table(spark, sf_dir, "embeddings"), 4
    vectors, d = whitening.fit_list(rows)
    model = whitening.fit(vectors, d)
    share = F.array(*[F.lit(float(e) / model.trace) for e in model.eigenvalues[:shown]]).cast("array<double>")
    out = whitening.whiten(rows, model, shown).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(whitening.identity_error(vectors, model, shown)).alias("identity_error"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query("op13_simhash_near_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.join(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
