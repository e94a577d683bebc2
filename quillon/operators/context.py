"""Context of bounded length from ranked chunks, and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

TOKENS_PER_CHAR, MAX_TOKENS, BUFFER, LEAST = 0.25, 4000, 100, 200

#: Prompts.
SYSTEM = "You are a helpful AI assistant that answers questions based on the provided context. \n\nGuidelines:\n- Use the retrieved context as your primary source of information\n- If the context doesn't contain enough information to answer the question, say so clearly\n- Provide specific references to the source material when possible\n- Keep your response focused and relevant to the question\n- Do not make up information that isn't in the context"
SYSTEM_CITING = 'You are a helpful AI assistant that answers questions based on the provided context.\n\nGuidelines:\n- Use the retrieved context as your primary source of information\n- Always cite your sources using the chunk numbers (e.g., "According to Chunk 1...")\n- If the context doesn\'t contain enough information, say so clearly\n- Provide specific references to the source material\n- Keep your response focused and relevant to the question\n- Do not make up information that isn\'t in the context'
ASK = "Please answer the question based on the provided context."
ASK_CITING = "Please answer the question based on the provided context. Make sure to cite the specific chunks you're referencing in your answer."


def dedup_content(ranking: DataFrame) -> DataFrame:
    """Of rows of a query whose content is equal but for case and white space, the first; with their new
    position (from 1)."""
    key = T.normalize_text(F.lower("content"))
    first = ranking.withColumn("__n", F.row_number().over(Window.partitionBy("qid", key).orderBy("rank"))).where("__n = 1").drop("__n")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def format_chunk(position: Column, content: Column, source_path: Column | None = None, section: Column | None = None, score: Column | None = None) -> Column:
    """A header line with the number and what else is given, and the content."""
    about = []
    if source_path is not None:
        about.append(F.when(source_path.isNotNull(), F.concat(F.lit("Source: "), F.element_at(F.split(source_path, "/"), -1))))
    if section is not None:
        about.append(F.when(section.isNotNull() & (section != "main"), F.concat(F.lit("Section: "), F.left(section, F.lit(30)))))
    header = F.concat(F.lit("[Chunk "), position.cast("string"), F.lit("]"))
    if about:
        joined = F.concat_ws(", ", *about)
        header = F.concat(header, F.when(joined != "", F.concat(F.lit(" ("), joined, F.lit(")"))).otherwise(""))
    if score is not None:
        header = F.concat(header, F.format_string(" [Score: %.3f]", score))
    return F.concat(header, F.lit("\n"), content)


def build_context(ranking: DataFrame, max_tokens: int = MAX_TOKENS, with_metadata: bool = True, with_scores: bool = False) -> DataFrame:
    """(qid, context, chunks) from ranking (qid, rank, content, source_path, section, score): formatted chunks
    in order while they fit; the first that doesn't is cut if more than 200 characters are left after a
    buffer of 100, and the rest is left out."""
    most = int(max_tokens / TOKENS_PER_CHAR)
    unique = dedup_content(ranking).withColumn("content", T.strip(F.col("content")))
    meta = {"source_path": F.col("source_path"), "section": F.col("section")} if with_metadata else {}
    shown = lambda c: format_chunk(F.col("position"), c, score=F.col("score") if with_scores else None, **meta)
    sized = unique.withColumn("full", shown(F.col("content")))
    upto = F.sum(F.length("full")).over(Window.partitionBy("qid").orderBy("position"))
    sized = sized.withColumn("used", upto - F.length("full")).withColumn("upto", upto)
    over = F.col("upto") > most
    first_over = F.min(F.when(over, F.col("position"))).over(Window.partitionBy("qid"))
    left = (F.lit(most) - F.col("used") - BUFFER).cast("int")
    part = F.when(~over, F.col("full")).when((F.col("position") == first_over) & (left > LEAST), shown(F.concat(F.substring(F.col("content"), F.lit(1), left), F.lit("..."))))
    parts = sized.withColumn("part", F.when(first_over.isNull() | (F.col("position") <= first_over), part))
    ordered = F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("position", "part"))))
    return parts.groupBy("qid").agg(ordered.alias("p")).select("qid", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("context"), F.size("p").cast("long").alias("chunks"))


def context_stats(ranking: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(qid, total_chunks, unique_chunks, duplicates_removed, total_chars, estimated_tokens, within_limit,
    chunks_included) of the context without metadata."""
    total = ranking.groupBy("qid").agg(F.count("*").alias("total_chunks"))
    unique = dedup_content(ranking).groupBy("qid").agg(F.count("*").alias("unique_chunks"))
    built = build_context(ranking, max_tokens, with_metadata=False)
    tokens = F.floor(F.length("context") * TOKENS_PER_CHAR)
    return total.join(unique, "qid").join(built, "qid").select("qid", "total_chunks", "unique_chunks", (F.col("total_chunks") - F.col("unique_chunks")).alias("duplicates_removed"), F.length("context").cast("long").alias("total_chars"), tokens.alias("estimated_tokens"), (tokens <= max_tokens).alias("within_limit"), F.col("chunks").alias("chunks_included"))


def build_prompt(query: Column, context: Column, citing: bool = True) -> tuple[Column, Column]:
    """System and user prompt."""
    user = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\n\n" + (ASK_CITING if citing else ASK)))
    return F.lit(SYSTEM_CITING if citing else SYSTEM), user
