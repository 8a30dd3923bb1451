"""Raw duel tables derived from a folder of order, document and page tables.

The project's own inputs are downloads.  These functions give tables of the same shape and any
size, so that every operator can be run and checked on whole tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Raw model names that exercise every normalization rule.
NAME_POOL = [
    "gpt-4o-mini-2024-07-18", "gpt-4.1-mini", "claude-3-5-sonnet-v2", "claude-4-5-sonnet",
    "mistral-large-2411", "Llama-3.1-405B", "mixtral-8x22b-instruct-v0.1", "o3-mini",
    "gemma-3-27b", "gemini-2.0-flash", "deepseek-r1-distill-llama-70b", "deepseek-v3-chat",
    "phi-4", "qwq-32b", "command-a", "c4ai-command-r-08-2024", "aya-expanse-8b",
    "gpt-oss-120b", "gpt_4_1", "abc-12", "magistral-medium", "lfm-40b",
    "hermes-3-llama-3.1-405b", "jamba-1.5-large", "glm-4.5", "grok-3-mini-beta",
    "ministral-8b-instruct-2410", "yi-1.5-34b-chat", "qwen2.5-coder-32b-instruct",
    "javascript:x", "none", "'quoted-7b'", "<b>bold-7b", "wnnzokjptdouqnjri3j4q4y2atgm4cs4kscf53u",
]

#: Keyword lists that do occur in the given documents, under the usual category names.
CHECK_DICTIONARIES = {
    "periods": {
        "Moyen Âge": ["le", "la", "les", "un", "une", "des"],
        "Renaissance": ["de la", "dans", "sur", "avec", "pour"],
        "XXe siècle": ["the", "of the", "and"],
        "Art contemporain": ["der", "die", "el"],
    },
    "domains": {
        "Peinture": ["qui", "que"],
        "Sculpture": ["that", "which", "this"],
        "Dessin": ["est", "pas"],
    },
    "regions": {
        "Île-de-France": ["en", "et", "éou"],
        "Bretagne": ["in", "on the"],
        "Corse": ["und", "ist", "über"],
    },
    "types": {
        "Musées": ["was", "were"],
        "Théâtres & Opéras": ["for", "from", "re"],
        # Words of a few sources only, so that the term lists of the models differ.
        "Archives": [
            "von", "mit", "los", "thatin", "ononst", "inoran", "orantion", "hehely", "ier", "éai", "ciónos",
            "belich", "atble", "threen", "ciónado", "ereden", "wher", "enheit", "èmentelle", "leêch",
            "lyound", "ñrrja", "achlichau", "ndonly",
        ],
    },
}
CHECK_CATALOGUE = {
    **CHECK_DICTIONARIES,
    "periods": {
        "Moyen Âge": ["la", "les"],
        "Renaissance": ["dans"],
        "XXe siècle": ["than", "there"],
        "Art contemporain": ["das"],
    },
    "types": {
        "Musées": ["was"],
        "Théâtres & Opéras": ["en"],
        "Archives": ["der"],
    },
}

#: Second category of the text duels, in turn; two of the three are cultural.
TOPICS = ["Musées et patrimoine", "Sport", "Théâtre"]


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a part of a table smaller than one split per core, as the given ones are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if size < cores * 128 * 1024 * 1024 else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool_name(index: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAME_POOL])
    return F.element_at(names, (index % len(NAME_POOL) + 1).cast("int"))


def duels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One duel per order; serves as raw conversations and as raw votes."""
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    quantity = F.col("l_quantity").cast("bigint")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count("*").alias("lines"),
            F.sum(quantity).alias("tokens_a"),
            F.sum(quantity * F.col("l_linenumber")).alias("tokens_b"),
            F.sum(price.cast("decimal(18,2)")).alias("kwh_a"),
            F.sum(price.cast("decimal(18,2)") * discount.cast("decimal(4,2)")).alias("kwh_b"),
            F.min("l_partkey").alias("p_partkey"),
        )
    )
    joined = (
        table(spark, sf_dir, "orders")
        .join(lines, "o_orderkey", "left")
        .join(
            table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"),
            "o_custkey",
            "left",
        )
        .join(table(spark, sf_dir, "part"), "p_partkey", "left")
    )
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    a, b = pool_name(key), pool_name(key * 7 + customer)
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    custom = key % 5 == 0
    flags = {
        "useful": 2, "creative": 3, "clear_formatting": 5, "incorrect": 7, "superficial": 11,
        "instructions_not_followed": 13,
    }
    return joined.select(
        key.alias("duel_id"),
        a.alias("model_a_name"),
        b.alias("model_b_name"),
        F.concat(a, F.lit("|"), b).alias("model_pair_name"),
        F.when(customer % 50 == 0, F.lit("")).otherwise(customer.cast("string")).alias("visitor_id"),
        F.concat(F.lit("s"), customer.cast("string")).alias("session_hash"),
        F.col("o_orderdate").alias("timestamp"),
        F.coalesce("lines", F.lit(0)).alias("conv_turns"),
        F.col("tokens_a").alias("total_conv_a_output_tokens"),
        F.col("tokens_b").alias("total_conv_b_output_tokens"),
        (F.col("kwh_a") + F.col("lines") * F.lit(Decimal("0.0000004"))).cast("double").alias("total_conv_a_kwh"),
        F.col("kwh_b").cast("double").alias("total_conv_b_kwh"),
        F.nullif(key % 7 * 10, F.lit(0)).cast("double").alias("model_a_total_params"),
        F.nullif(customer % 5 * 10, F.lit(0)).cast("double").alias("model_b_total_params"),
        F.when(status == "P", F.lit(True))
        .when(priority == "4-NOT SPECIFIED", F.lit(None))
        .otherwise(F.lit(False))
        .alias("both_equal"),
        F.when(status == "F", a).when(status == "O", b).alias("chosen_model_name"),
        F.when(custom, F.lit("custom")).otherwise(F.lit("random")).alias("mode"),
        F.when(key % 10 == 0, F.array(a, b)).when(custom, F.array(a)).alias(
            "custom_models_selection"
        ),
        F.when(F.col("p_type").isNotNull(), F.array("p_type", "c_mktsegment")).alias("categories"),
        F.split("p_name", " ").alias("keywords"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), F.array(F.lit("fr"), F.lit("en")))
        .otherwise(F.array(F.lit("en")))
        .alias("languages"),
        F.repeat(F.concat("p_name", F.lit(" ")), (F.col("lines") * 3).cast("int")).alias(
            "opening_msg"
        ),
        priority.alias("selected_category"),
        *[
            ((key if s == "a" else customer) % n == 0).alias(f"conv_{flag}_{s}")
            for flag, n in flags.items()
            for s in ("a", "b")
        ],
        F.when(status == "F", F.concat(F.lit("  "), priority, F.lit(" "))).alias("conv_comments_a"),
        F.when(status == "O", priority).alias("conv_comments_b"),
    )


def duel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw names of all duels, from the two key columns they are made of."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        pool_name(key).alias("model_a_name"), pool_name(key * 7 + customer).alias("model_b_name")
    )


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reaction per order line."""
    line = table(spark, sf_dir, "lineitem")
    own = duels(spark, sf_dir).select(
        "duel_id", "model_a_name", "model_b_name", "conv_turns", "visitor_id", "session_hash"
    )
    flag = F.col("l_returnflag")
    return own.join(line, F.col("duel_id") == F.col("l_orderkey")).select(
        F.col("duel_id").alias("id"),
        F.col("l_linenumber").alias("msg_rank"),
        F.col("visitor_id"),
        F.col("session_hash"),
        "model_a_name",
        "model_b_name",
        "conv_turns",
        F.when(F.col("l_linenumber") % 2 == 1, F.lit("a")).otherwise(F.lit("b")).alias("model_pos"),
        F.when(flag == "A", F.lit(True)).when(flag == "R", F.lit(False)).alias("liked"),
        (F.col("l_quantity") > 25).alias("useful"),
        (F.col("l_discount") > 0.05).alias("creative"),
        (F.col("l_tax") > 0.04).alias("clear_formatting"),
        (F.col("l_discount") < 0.02).alias("instructions_not_followed"),
        (F.col("l_tax") < 0.02).alias("incorrect"),
        (F.col("l_quantity") < 5).alias("superficial"),
        F.col("l_returnflag").alias("comment"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(table(spark, sf_dir, "documents"), "doc_id")


def alternating(parts: Column) -> Column:
    """Messages from pieces of text: user first, then assistant, and so on."""

    def message(part: Column, i: Column) -> Column:
        role = F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
        return F.struct(role.alias("role"), part.alias("content"))

    return F.transform(parts, message)


def text_duels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One duel per document: side a talks in its lines, side b in its sentences."""
    key, text = F.col("doc_id"), F.col("text")
    lines = F.split(text, "\n")
    quoted = F.transform(
        lines, lambda x: F.concat(F.lit("{'role': 'user', 'content': '"), x, F.lit("'}"))
    )
    listed = F.array_join(quoted, ", ")
    topic = F.get(F.array(*[F.lit(name) for name in TOPICS]), (F.pmod(key, F.lit(len(TOPICS)))).cast("int"))
    return documents(spark, sf_dir).select(
        key.alias("duel_id"),
        pool_name(key).alias("model_a_name"),
        pool_name(key * 7 + F.col("n_chars")).alias("model_b_name"),
        F.size(lines).cast("bigint").alias("conv_turns"),
        alternating(lines).alias("conversation_a"),
        alternating(F.split(text, "\\. ")).alias("conversation_b"),
        F.when(key % 10 == 3, F.concat(F.lit("["), listed, F.lit("] and more")))
        .when(key % 10 == 4, F.concat(F.lit("['{a}', 7, "), listed, F.lit("]")))
        .otherwise(F.concat(F.lit("["), listed, F.lit("]")))
        .alias("transcript"),
        text.alias("opening_msg"),
        F.array("source", topic).alias("categories"),
        F.split(F.lower(text), " ").alias("keywords"),
        F.array("lang").alias("languages"),
        F.col("source").alias("visitor_id"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, doc_id, text): every document, its source taken as the model."""
    return documents(spark, sf_dir).select(
        F.col("source").alias("model"), "doc_id", F.lower("text").alias("text")
    )


def artworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a catalogue row; its whole text serves as author, domain and period."""
    text = F.col("text")
    return documents(spark, sf_dir).select(
        text.alias("Auteur"), text.alias("Domaine"), text.alias("Periode_de_creation")
    )


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One venue per navigation link of every page; title and footer serve as region and type."""
    html = F.col("html")
    links = F.regexp_extract_all(html, F.lit('<li><a href="[^"]*">([^<]*)</a>'), F.lit(1))
    return spread_small(table(spark, sf_dir, "pages"), "page_id").select(
        F.explode(links).alias("Nom"),
        F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("Region"),
        F.regexp_extract(html, "&middot; ([^<]*)</footer>", 1).alias("Type_equipement"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price row per part: free, missing, unreadable or a small number."""
    name = pool_name(F.col("p_partkey"))
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("position"),
        F.concat(F.lower("p_brand"), F.lit("/"), name).alias("id"),
        F.when(name.startswith("phi"), F.lit("0"))
        .when(name.startswith("yi"), F.lit("abc"))
        .when(~name.startswith("glm"), F.concat(F.lit("0.0000"), cents))
        .alias("completion"),
    )
