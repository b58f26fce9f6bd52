"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its measurements and one failure
bit per rule are written to a table, the ledger. Policies are versioned masks over those bits, so a new
policy, or an ablation of one rule, is a bitwise operation on the ledger and
never reads a text again. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"

#: Rule name -> failure, over the measured columns; the position is the rule's bit.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
    "shouting": "10 * n_upper > 7 * n_chars_seen",
}
#: Rejected rows up to this many (8 bytes each) are broadcast; more are shuffled.
BROADCAST_ROWS = 1 << 20
BASE_RULES = ("few_words", "repeated_words")
#: Version -> rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE_RULES,
    "v2": (*BASE_RULES, "symbol_heavy", "short_words", "long_words", "repeated_lines"),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def words_of(text: Column, separators: str = _SPACE) -> Column:
    """The text's words; a separator at either end makes no empty word."""
    return F.filter(F.split(text, separators), lambda w: w != "")


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the measurements that the rules use."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    base = docs.select(*[docs[c] for c in keep], text.alias("_text"))
    base = base.withColumn("_words", words_of(F.col("_text")))
    base = base.withColumn("n_words", F.size("_words").cast("long"))
    # equal 3-word windows are neighbours once sorted; a window is marked when it equals either neighbour
    gram = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    grams = F.transform(
        F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(gram(F.col("_words"), i).alias("g"), i.alias("i")),
    )
    base = base.withColumn("_grams", F.sort_array(grams))
    marked = F.filter(
        F.transform(F.col("_grams"), lambda x, k: F.when((F.get(F.col("_grams"), k - 1)["g"] == x["g"]) | (F.get(F.col("_grams"), k + 1)["g"] == x["g"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    base = base.withColumn("_at", F.sort_array(marked))
    # covered words: each marked window adds its three, less what the window before covers already
    covered = F.aggregate(
        F.col("_at"),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"].cast("long"),
    )
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("n_repeat_words", covered).withColumn("_lines", lines)
    chars = F.length(F.col("_text"))
    # one code point each, so a length difference counts them
    spaces = F.length(F.regexp_replace(F.col("_text"), _SPACE, ""))
    measures = F.struct(
        "n_words",
        spaces.cast("long").alias("word_chars"),
        (chars - F.length(F.translate(F.col("_text"), _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("long").alias("n_lines"),
        (chars - F.length(F.regexp_replace(F.col("_text"), "[A-Z]+", ""))).cast("long").alias("n_upper"),
        spaces.cast("long").alias("n_chars_seen"),
    )
    # a generator of one row: conditions on the measures aren't moved below it, where each would measure again
    return base.select(*keep, F.inline(F.array(measures)))


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and ``failed``, a bitmask with one bit a rule.

    Defined results: a null or empty text has no words and every count 0; a
    null doc_id stays; repeated rows are judged each; an empty table gives no
    rows; columns other than ``keep`` and text are not read.
    """
    bits = [F.when(F.expr(rule), F.lit(bit(name))).otherwise(F.lit(0)) for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs, keep).withColumn("failed", total.cast("long"))


def verdict(failed: Column, policy: str) -> Column:
    """True where no rule of the policy failed."""
    return failed.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """One row a rule of the policy: rejected by it, by it alone, and kept without it.

    One aggregation over the stored bits.
    """
    failed, full = F.col("failed"), mask(policy)
    count = lambda test, name: F.sum(test.cast("long")).alias(name)
    columns = []
    for rule in POLICIES[policy]:
        own = failed.bitwiseAND(F.lit(bit(rule)).cast("long")) != 0
        rest = failed.bitwiseAND(F.lit(full & ~bit(rule)).cast("long")) == 0
        columns.append(F.struct(F.lit(rule).alias("rule"), count(own, "rejected"), count(own & rest, "rejected_alone"), count(rest, "kept_without")))
    return ledger_rows.agg(F.array(*columns).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def decisive(failed: Column, policy: str) -> Column:
    """The bit of the one rule without which the policy would keep the document; 0 where there is none."""
    own = failed.bitwiseAND(F.lit(mask(policy)).cast("long"))
    return F.when(own.bitwiseAND(own - 1) == 0, own).otherwise(F.lit(0).cast("long"))


def stored_ledger(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """The ledger as a written table, a row an input row, with doc_id and a digest of both that finds the row again."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("text_key"), text.alias("text"))
    return workspace.keep(ledger(keyed, ("doc_id", "text_key")), "ledger")


def kept_documents(docs: DataFrame, policy: str, workspace: Workspace | None = None) -> DataFrame:
    """The input rows, with all their columns, that the policy keeps, read off the stored ledger.

    Repeated rows are kept or rejected together; null doc_ids and null texts are
    rows like others; an empty table gives no rows.
    """
    ws = workspace or Workspace(docs.sparkSession, "quality")
    names = docs.columns
    bad = stored_ledger(docs, ws).filter(~verdict(F.col("failed"), policy)).select("text_key").distinct()
    bad = ws.keep(bad, "rejected")
    # the digest covers doc_id and text, so it alone finds the row
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.xxhash64(docs["doc_id"].cast("long"), text).alias("text_key"))
    return packed.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, "text_key", "left_anti").select("row.*")
