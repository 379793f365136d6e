"""Extraction from crawl output with regular expressions of the engine; rows are (task_id, raw_output, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSI = r"\u001b\[[0-9;]*[A-Za-z]"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
ONION_URL = r"http://[a-z2-7]{16,56}\.onion[^\s\x1b<>\"{}|\\^`\[\]]*"
DOCUMENT = r"(?i)https?://\S+\.(?:pdf|docx|doc|txt|xml|json|csv)"


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, CSI, "")


def all_of(c: Column, pattern: str) -> Column:
    """Every match, each once, sorted; null text gives none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))))


def clean_onion_domain(c: Column, append: bool = False) -> Column:
    """Lower case, without trailing dots or escapes, cut after .onion; `append` adds .onion to names without it."""
    d = F.regexp_replace(F.lower(F.trim(c)), r"[.\u001b]+$", "")
    cut = F.regexp_extract(d, r"^(.*?\.onion)", 1)
    return F.when(cut != "", cut).otherwise(F.concat(d, F.lit(".onion")) if append else d)


def sentiment(c: Column) -> Column:
    value = lambda name: F.regexp_extract(c, name + r"\s*=\s*(-?[0-9.]+)", 1).try_cast("double")
    both = F.struct(value("Polarity").alias("polarity"), value("Subjectivity").alias("subjectivity"))
    return F.when(value("Polarity").isNotNull() & value("Subjectivity").isNotNull(), both)


def metadata(c: Column) -> Column:
    """A JSON object as a map of texts; null if it can't be read."""
    return F.from_json(strip_ansi(c), "map<string,string>")


def sites(df: DataFrame, strict: bool = False) -> DataFrame:
    """One row per numbered entry with an onion link: title, description, URL, domain, keywords, sentiment, metadata, counts.

    strict: entries end at their first line, so that none has a link (as the stored results show).
    """
    if strict:
        df = df.filter(F.lit(False))
    text = strip_ansi(F.coalesce("raw_output", F.lit("")))
    parts = F.split(text, r"\n(?=\d+\.\s*\n)")
    rows = df.select("*", F.posexplode(parts).alias("position", "entry")).filter(F.col("position") > 0)
    find = lambda pattern: F.regexp_extract("entry", pattern, 1)
    url = find(r"Onion Link:\s*(http://[a-z2-7]+\.onion[^\s]*)")
    words = F.transform(F.split(find(r"Keywords?:\s*(.+)"), ","), lambda x: F.trim(x))
    out = rows.select(
        "task_id", "position", F.coalesce(F.nullif(F.trim(find(r"Website:\s*(.+)")), F.lit("")), F.lit("Unknown")).alias("title"),
        F.coalesce(F.nullif(F.trim(find(r"Information:\s*(.+)")), F.lit("")), F.lit("No description provided")).alias("description"), F.trim(url).alias("onion_url"),
        F.regexp_extract(url, r"http://([a-z2-7]+\.onion)", 1).alias("onion_domain"), F.filter(words, lambda x: x != "").alias("keywords"), sentiment(find(r"Sentiment:\s*(.+)")).alias("sentiment"),
        metadata(find(r"Metadata:\s*(\{.+\})")).alias("metadata"), find(r"Links Found:\s*(\d+)").try_cast("int").alias("links_found"),
        all_of(find(r"Emails Found:\s*(.+)"), EMAIL).alias("emails_found"), all_of(find(r"Documents Found:\s*(.+)"), r"https?://[^\s,]+").alias("documents_found"),
    )
    return out.filter(F.col("onion_url") != "")


def first_sites(found: DataFrame) -> DataFrame:
    """Of each URL of a task the first entry."""
    firsts = found.groupBy("task_id", "onion_url").agg(F.min("position").alias("position"))
    return found.join(firsts, ["task_id", "onion_url", "position"], "left_semi")


def entities(df: DataFrame, strict: bool = False) -> DataFrame:
    """Sorted sets per task from the tool's lists and the whole text: urls, onion and clearnet domains, emails, ips, keywords,
    documents. Lists may be missing (null). strict keeps colour codes in keywords."""
    text = strip_ansi(F.coalesce("raw_output", F.lit("")))
    none = F.array().cast("array<string>")
    listed = lambda name: F.transform(F.coalesce(F.col("darkdump_results")[name], none), lambda x: F.trim(strip_ansi(x)))
    merged = lambda *a: F.array_sort(F.filter(F.array_distinct(F.flatten(F.array(*a))), lambda x: x != ""))
    in_text = all_of(text, ONION_URL)
    domains = listed("domains")
    onions = F.filter(F.transform(domains, lambda d: clean_onion_domain(d, append=True)), lambda d: F.contains(d, F.lit(".onion")) & (F.length(d) > 20))
    clear = F.filter(domains, lambda d: ~(F.contains(clean_onion_domain(d, append=True), F.lit(".onion")) & (F.length(clean_onion_domain(d, append=True)) > 20)) & ~F.endswith(d, F.lit(".")) & F.contains(d, F.lit(".")))
    words = F.transform(F.coalesce(F.col("darkdump_results")["keywords"], none), lambda x: F.trim(x)) if strict else listed("keywords")
    return df.select(
        "task_id", merged(F.filter(listed("urls"), lambda u: F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://"))), in_text).alias("urls"),
        merged(onions, F.transform(in_text, lambda u: F.regexp_extract(u, r"http://([a-z2-7]+\.onion)", 1))).alias("onion_domains"), merged(F.transform(clear, F.lower)).alias("clearnet_domains"),
        merged(F.filter(listed("emails"), lambda e: F.contains(e, F.lit("@"))), all_of(text, EMAIL)).alias("emails"), merged(listed("ips")).alias("ips"), merged(words).alias("keywords"), all_of(text, DOCUMENT).alias("document_links"),
    )


def statistics(found: DataFrame, per_site: DataFrame) -> DataFrame:
    """Counts per task: sites, domains, URLs by kind, emails, addresses, keywords, documents, and sites with each detail."""
    onion = F.filter("urls", lambda u: F.contains(u, F.lit(".onion")))
    counts = per_site.groupBy("task_id").agg(F.count("*").alias("total_websites"), F.count_if(F.size("metadata") > 0).alias("with_metadata"), F.count_if(F.size("keywords") > 0).alias("with_keywords"), F.count_if(F.col("sentiment").isNotNull()).alias("with_sentiment"))
    sizes = found.select(
        "task_id", F.size("onion_domains").alias("onion_domains"), F.size("clearnet_domains").alias("clearnet_domains"), F.size("urls").alias("total_urls"), F.size(onion).alias("onion_urls"), (F.size("urls") - F.size(onion)).alias("clearnet_urls"),
        F.size("emails").alias("total_emails"), F.size("ips").alias("total_ips"), F.size("keywords").alias("total_keywords"), F.size("document_links").alias("document_links"),
    )
    return sizes.join(counts, "task_id", "left").na.fill(0)
