"""The registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierspark.llm import bitpack, bpe_trie, crf_pii, golomb_dedup, hard_negatives, nbsvm, packing, simhash, stripes, topk, url_rules, warc, wu_manber
from tierspark.llm.common import pick, table
from tierspark.llm.url_rules import ALLOW, BLOCK, PatternRule, PlaceRule

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"

# The place rules the query is asked for, and words of hosts that sell what nobody should learn from.
PLACES = (
    PlaceRule("org/", ALLOW),
    PlaceRule("example.org/es/", BLOCK),
    PlaceRule("example.org/en/1", BLOCK),
    PlaceRule("com/fr/", ALLOW),
    PlaceRule("com/de/", BLOCK),
)
GAMBLING = (
    "baccarat bet betting bets bingo blackjack bookmaker bookmakers casino casinos craps freespins gamble gambling jackpot jackpots "
    "keno lottery lotto poker roulette scratchcards slot slots sportsbook sportsbooks wager wagering"
).split()
DRUGS = (
    "cialis fentanyl hydrocodone kamagra levitra meds modafinil oxycodone oxycontin pharmacy phentermine pill pills steroids tramadol "
    "valium viagra vicodin xanax"
).split()
ADULT = "adult camgirls erotic erotica escort escorts hentai hookup hookups milf nsfw nude nudes porn porno sex sexcam webcams xxx".split()
# A part of a host that is such a word, or begins or ends with it and a hyphen.
HOST_FORMS = ("||{}^", "||{}-*^", "||*-{}^")
# Pages that hold no text to learn from, or without end: log-ins, baskets, sessions, replies, calendars, adverts, feeds of actions.
PAGES = (
    "/login^", "/log-in^", "/signin^", "/sign-in^", "/signup^", "/sign-up^", "/logout^", "/register.php^", "/wp-login.php^", "/wp-admin/",
    "/user/login^", "/account/login^", "/oauth/", "/password-reset^", "/forgot-password^", "/cart/", "/cart.php^", "/basket/", "/checkout/",
    "/add-to-cart^", "^add-to-cart=", "/wishlist/", "/compare/add/", "/cgi-bin/", "/xmlrpc.php^", "/trackback/", "^replytocom=",
    "^phpsessid=", "^jsessionid=", "^sessionid=", "^cfid=*^cftoken=", "^sid=*^sid=", "^share=*^nb=", "/print/*/print/", "^action=edit^",
    "^action=history^", "^oldid=", "^diff=*^oldid=", "/special:*^returnto=", "/calendar/*/day/", "/calendar/*/week/", "^ical=",
    "/events/*^tribe-bar-date=", "^tribe_event_display=", "/adserver/", "/adclick^", "/ads/click^", "/banner/click^", "^clickid=*^affid=",
    "^affiliate_id=", "/affiliate/redirect^", "/out.php^url=", "/redirect.php^url=", "/goto.php^url=", "^gclid=*^adgroupid=", "/popunder^",
)
PATTERNS = tuple(
    PatternRule(form)
    for form in (*(form.format(word) for word in (*GAMBLING, *DRUGS, *ADULT) for form in HOST_FORMS), *PAGES)
)


def op1_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = pick(table(spark, sf, "embeddings"), id="vec_id", vector="embedding")
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("vector").isNotNull() & finite)
    return topk.top_k(good.select("id", topk.scaled(F.col("vector")).alias("vector")), F.col("id") % 100 == 0, 10)


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return golomb_dedup.exact_duplicates(table(spark, sf, "documents"))


def op3_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = url_rules.judge(table(spark, sf, "pages"), PLACES, PATTERNS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_trie.digests(table(spark, sf, "documents"), public_tokenizers.path(WORD_BPE))


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path(WORD_BPE), end_id=0)


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return nbsvm.score(docs, nbsvm.train(docs, table(spark, sf, "labels")))


def op7_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bitpack.round_trip(table(spark, sf, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2)


def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    return crf_pii.find(table(spark, sf, "documents"))


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf, "pages")))


def op11_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = wu_manber.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = pick(table(spark, sf, "embeddings"), id="vec_id", label="label", vector="embedding")
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("vector", lambda x: F.floor(x.cast("double") * 256))
    good = rows.where(F.col("vector").isNotNull() & finite).select("id", label.alias("label"), vector.alias("vector"))
    return hard_negatives.hard_negatives(good, F.col("id") % 50 == 0)


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return stripes.collocations(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for name, query in list(globals().items()) if name.startswith("op") and callable(query)
}
