"""What a question asks for, read from its words, and how a result is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.ranking import global_rank
from storelens.session import materialize

# Topics and their keywords (French, English, Arabic); the first topic that matches wins.
TOPICS = {
    "category": ("catégorie", "categorie", "category", "فئة", "فئات"),
    "city": ("ville", "villes", "city", "cities", "مدينة", "مدن"),
    "product": ("produit", "produits", "product", "منتج", "منتجات"),
    "customer": ("client", "clients", "customer", "عميل", "عملاء"),
    "payment": ("paiement", "payment", "دفع"),
    "review": ("avis", "review", "note", "تقييم"),
    "segment": ("segment", "segments"),
    "month": ("mois", "month", "mensuel", "شهر"),
}
OTHER_TOPIC = "other"

# Words in a column name that tell its unit.
MONEY_WORDS = ("revenue", "amount", "value", "spent", "monetary", "price", "total")
SHARE_WORDS = ("pct", "percent", "percentage", "rate")

# Ranking words, and numbers in words' order.
# (?U) makes \b and \d follow Unicode, as the accented and Arabic words need.
_TOP_N = r"(?U)\b(?:top|meilleurs?|premiers?|أفضل)\s*(\d+)"
_ANY_NUMBER = r"(?U)\b(\d+)\b"
_DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def question_topics(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds topic: the first topic one of whose keywords occurs in the text."""
    lowered = F.lower(F.col(text))
    topic = None
    for name, words in TOPICS.items():
        hit = lowered.rlike("|".join(words))
        topic = F.when(hit, name) if topic is None else topic.when(hit, name)
    return questions.withColumn("topic", topic.otherwise(OTHER_TOPIC))


def question_top_n(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds requested_n: the number after a ranking word, else a first number in 1..100, else NULL."""
    lowered = F.translate(F.lower(F.col(text)), *_DIGITS)

    def number(pattern: str) -> Column:
        return F.regexp_extract(lowered, pattern, 1)

    ranked, plain = number(_TOP_N), number(_ANY_NUMBER).try_cast("bigint")
    asked = F.when(ranked != "", ranked.try_cast("bigint")).otherwise(
        F.when(plain.between(1, 100), plain)
    )
    return questions.withColumn("requested_n", F.nullif(asked, F.lit(0).cast("bigint")))


def _spaced(c: Column, digits: int) -> Column:
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(" "))


def _shown(field: T.StructField) -> Column:
    c, name, kind = F.col(f"`{field.name}`"), field.name.lower(), field.dataType
    if isinstance(kind, T.IntegralType):
        return _spaced(c, 0)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        if any(word in name for word in MONEY_WORDS):
            return F.concat(_spaced(c, 2), F.lit(" BRL"))
        if any(word in name for word in SHARE_WORDS):
            return F.concat(F.replace(F.format_number(c, 2), F.lit(","), F.lit("")), F.lit("%"))
        return _spaced(c, 2)
    return c.cast("string")


def format_results(df: DataFrame) -> DataFrame:
    """All columns as text: the first as it is, numbers with spaces, BRL or % by column name."""
    label, *values = df.schema
    return df.select(
        F.col(f"`{label.name}`").cast("string").alias(label.name),
        *[_shown(f).alias(f.name) for f in values],
    )


# What an answer is headed by, for each topic.
HEADINGS = {
    "category": "Categories", "city": "Cities", "product": "Products", "customer": "Customers",
    "payment": "Payments", "review": "Reviews", "segment": "Segments", "month": "Months",
}


def answer_table(questions: DataFrame, result: DataFrame) -> DataFrame:
    """question_id, position, line: the answer to every question as numbered lines of text.

    `questions` has topic and requested_n, `result` is a formatted result of a query, in its order. Line 0 is the
    heading by topic; then come the first requested_n rows, or all of them where no number is asked for, with their
    numbers, and what is left over as a count. Rows are numbered over the cluster and joined by their number.
    """
    placed = materialize(
        result.select(answer_lines(result).alias("text"), F.monotonically_increasing_id().alias("at")), "answer-lines")
    lines = global_rank(placed, ["at"], "position", "answer-rank").select("position", "text")
    total = placed.count()
    wanted = F.least(F.coalesce("requested_n", F.lit(total)), F.lit(total)).cast("bigint")
    heading = None
    for topic, words in HEADINGS.items():
        hit = F.col("topic") == topic
        heading = F.when(hit, words) if heading is None else heading.when(hit, words)
    asked = questions.select("question_id", heading.otherwise("Result").alias("heading"), wanted.alias("wanted"))
    left = F.lit(total) - F.col("wanted")
    ends = asked.select("question_id", F.inline(F.filter(
        F.array(
            F.struct(F.lit(0).cast("bigint").alias("position"), F.col("heading").alias("line")),
            F.when(left > 0, F.struct(
                (F.col("wanted") + 1).alias("position"),
                F.concat(F.lit("... and "), left.cast("string"), F.lit(" more rows")).alias("line")))),
        lambda x: x.isNotNull())))
    numbers = asked.where("wanted > 0").select("question_id", F.explode(F.sequence(F.lit(1), "wanted")).alias("position"))
    body = numbers.join(lines, "position").select(
        "question_id", "position", F.concat(F.col("position").cast("string"), F.lit(". "), F.col("text")).alias("line"))
    return ends.unionByName(body).withColumn("position", F.col("position").cast("int"))


def answer_lines(df: DataFrame) -> Column:
    """`**label** — **value** — ...` of a formatted result, as one column."""
    return F.concat_ws(" — ", *[F.concat(F.lit("**"), F.col(f"`{c}`"), F.lit("**")) for c in df.columns])
