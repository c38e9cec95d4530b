"""Text functions over string columns: tokens, sentences, chunks, windows, passages, token prices, guards, normalisers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9_]+"
CJK = r"[㐀-䶿一-鿿]"
SPACE = r"\s+"


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case and nothing else: lower() would make ASCII letters of some other signs."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def squeezed(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ascii_words(text: Column) -> Column:
    """Lower-cased ASCII words, repeats included. What lower() would make ASCII letters of has gone before it."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9_]+", " ")), " "), "")


def has_cjk(text: Column) -> Column:
    """Only texts of more bytes than characters are searched."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(CJK)


def tokens(text: Column) -> Column:
    """Distinct lower-cased ASCII words, CJK characters and CJK pairs of neighbours."""
    words = ascii_words(text)
    runs = extract_all(text, f"{CJK}+")
    singles = F.flatten(F.transform(runs, lambda r: F.split(r, "")))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.when(F.length(r) > 1, F.substr(r, i, F.lit(2))))))
    plain = F.array_distinct(words)
    return F.when(has_cjk(text), F.array_distinct(F.filter(F.concat(words, singles, pairs), lambda t: t.isNotNull() & (t != "")))).otherwise(plain)


def sentences(text: Column) -> Column:
    """Pieces after sentence signs, or after a dot and white space; stripped, without empty ones."""
    # a piece ends with a sign or the stripped text, and the white space behind it belongs to the cut: no piece has any at its ends
    return F.array_remove(F.split(stripped(text), r"(?<=[!?。！？])\s*|(?<=\.)\s+"), "")


def leading_sentence(text: Column) -> Column:
    """The first of sentences(), or an empty text, without cutting the rest."""
    return F.coalesce(F.regexp_extract(text, r"(?s)\A\s*(.*?(?:[!?。！？]|\.(?=\s)|(?=\s*\z)))", 1), F.lit(""))


def chunk_starts(length: Column, size: int, overlap: int) -> Column:
    """Where chunks of size begin so that each overlaps the last by overlap and the last one ends the text."""
    size, step = max(100, size), max(1, max(100, size) - max(0, min(overlap, max(100, size) - 1)))
    count = F.greatest(F.ceil((length - size) / step).cast("int"), F.lit(0)) + 1
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * step)).otherwise(F.array().cast("array<int>"))


def chunks(text: Column, size: int = 700, overlap: int = 100) -> Column:
    """Array of struct(chunk_index, content)."""
    starts = chunk_starts(F.length(text), size, overlap)
    return F.transform(starts, lambda s, k: F.struct(k.alias("chunk_index"), F.substr(text, s + 1, F.lit(max(100, size))).alias("content")))


def windows(text: Column, width: int, step: int) -> Column:
    """Pieces of width characters every step characters up to the end, blank ones left out."""
    n = F.length(text)
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / step).cast("int")), lambda k: k * step)
    return F.filter(F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(width))), lambda w: w.rlike(r"\S"))


def evidence_windows(text: Column, max_chars: int = 280) -> Column:
    """T4: the squeezed text, or windows of max_chars of it that overlap by a third (40 at least)."""
    return squeezed_windows(squeezed(text), max_chars)


def squeezed_windows(t: Column, max_chars: int = 280) -> Column:
    """evidence_windows() of a squeezed text, which for long texts has to be a column: the windows are cut in a lambda."""
    step = max(1, max_chars - max(40, max_chars // 3))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= max_chars, F.array(t)).otherwise(windows(t, max_chars, step))


def passages(text: Column, width: int = 1200, overlap: int = 160) -> Column:
    """T5: sentences packed to width characters (not counting the joining spaces); longer sentences are cut in windows."""
    step = max(1, width - min(max(0, overlap), width - 1))
    empty = F.array().cast("array<string>")
    begin = F.struct(empty.alias("out"), empty.alias("now"), F.lit(0).alias("size"))
    closed = lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["out"])

    def add(acc: Column, s: Column) -> Column:
        n = F.length(s)
        full = (F.size(acc["now"]) > 0) & (acc["size"] + n > width)
        long = F.struct(F.concat(closed(acc), windows(s, width, step)).alias("out"), empty.alias("now"), F.lit(0).alias("size"))
        fresh = F.struct(closed(acc).alias("out"), F.array(s).alias("now"), n.alias("size"))
        more = F.struct(acc["out"].alias("out"), F.concat(acc["now"], F.array(s)).alias("now"), (acc["size"] + n).alias("size"))
        return F.when(n > width, long).when(full, fresh).otherwise(more)

    parts = sentences(text)
    packed = F.aggregate(parts, begin, add, closed)
    return F.when(F.size(parts) > 1, packed).when(F.length(text) <= width, F.array(text)).otherwise(windows(text, width, step))


def context_tokens(text: Column) -> Column:
    """A token per four ASCII characters, begun ones too, and one per other character; 1 at least."""
    ascii_only = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.greatest(F.lit(1), F.floor((ascii_only + 3) / 4).cast("int") + F.length(text) - ascii_only)


def cost_tokens(text: Column) -> Column:
    """A token per four characters, begun ones too; none for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / 4).cast("int")))


def truncated(text: Column, limit: int) -> Column:
    """The longest prefix of at most limit context tokens, without white space at its end.

    A prefix of n characters, a of them ASCII, costs (a+3)//4 + n - a: it never falls as n grows, so the prefix's
    length is the number of lengths whose cost is within the limit. Only 4*limit+1 characters can fit."""
    head = F.substr(text, F.lit(1), F.lit(4 * limit + 1))
    marks = F.transform(F.split(head, ""), lambda c: F.when(c == "", None).when(c.rlike(r"^[\x00-\x7F]$"), 1).when(c.rlike(r"^\s$"), 1).otherwise(0))
    begin = F.struct(F.lit(0).alias("a"), F.lit(0).alias("o"), F.lit(0).alias("n"))

    def add(acc: Column, mark: Column) -> Column:
        a, o = acc["a"] + mark, acc["o"] + 1 - mark
        fits = F.greatest(F.lit(1), F.floor((a + 3) / 4).cast("int") + o) <= limit
        return F.struct(a.alias("a"), o.alias("o"), (acc["n"] + F.when(fits, 1).otherwise(0)).alias("n"))

    keep = F.aggregate(F.filter(marks, lambda m: m.isNotNull()), begin, add)["n"]
    return F.when(context_tokens(text) <= limit, text).otherwise(F.regexp_replace(F.substr(text, F.lit(1), keep), r"\s+$", ""))


def cleaned(text: Column) -> Column:
    """Without NUL characters, YAML front matter, white space at line ends and around the whole."""
    t = F.regexp_replace(text, r"\x00", "")
    t = F.regexp_replace(t, r"(?s)\A---\s*\n.*?\n---\s*\n", "")
    return stripped(F.regexp_replace(t, r"(?m)[ \t\x0B\f\r]+$", ""))


def title_of(text: Column, fallback: Column) -> Column:
    """The first `# ` heading, else the fallback with `_` and `-` as spaces."""
    head = F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1)
    return F.when(head != "", head).otherwise(F.trim(F.regexp_replace(fallback, "[_-]+", " ")))


def slug(path: Column) -> Column:
    """`local-` and the lower-cased path with all but letters and digits as single dashes."""
    body = F.regexp_replace(F.regexp_replace(F.lower(path), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("local-"), F.when(body == "", "document").otherwise(body))


def without_tags(html: Column, limit: int | None = None) -> Column:
    """T12, as far as expressions go: tags become spaces, white space is squeezed, the text is cut at limit."""
    t = squeezed(F.regexp_replace(html, r"<[^>]+>", " "))
    return t if limit is None else F.regexp_replace(F.substr(t, F.lit(1), F.lit(limit)), r"\s+$", "")


# What marks an instruction inside a text.
ROLE_SYNTAX = r"(?:^|\s)(?:system|assistant|developer|tool)\s*:|<\s*/?\s*(?:system|assistant|developer|tool|function)|(?:tool_call|function_call|recipient_name)"
INJECTION = (
    r"ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?",
    r"disregard\s+(?:all\s+)?(?:previous|prior|above)",
    r"reveal\s+(?:the\s+)?(?:system|developer)\s+prompt",
    r"you\s+are\s+now\s+(?:a|an)\b",
    r"忽略(?:以上|之前|前面|所有).{0,12}(?:指令|要求|提示词)",
    r"(?:泄露|输出|展示).{0,12}(?:系统提示词|开发者指令|密钥|api\s*key)",
    r"你现在是.{0,20}(?:助手|智能体|模型)",
)
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
ANY_URL = r"(?i)(?:https?|file|ftp)://"


def injected(text: Column) -> Column:
    """Does the squeezed text hold role or tool syntax, or an instruction to the model?"""
    return squeezed(text).rlike("(?i)" + "|".join([ROLE_SYNTAX, *INJECTION]))


ANYWHERE = ROLE_SYNTAX.replace(r"(?:^|\s)", "")


# Each of the patterns needs one of these, in lower case.
NEEDED = ("system", "assistant", "developer", "tool", "function", "recipient_name", "ignore", "disregard", "reveal", "you", "忽略", "泄露", "输出", "展示", "你现在是")


def suspect(text: Column, lowered: Column | None = None) -> Column:
    """No sentence of a text can be injected unless this holds: the patterns without their left edge, on the whole text. lowered, where given, is lower(text) as a column: texts without the words that a pattern needs are not matched."""
    found = squeezed(text).rlike("(?i)" + "|".join([ANYWHERE, *INJECTION]))
    return found if lowered is None else reduce(or_, [lowered.contains(w) for w in NEEDED]) & found


def sanitised_parts(text: Column) -> tuple[Column, Column]:
    """(text without instruction-like sentences and control characters, whether any was dropped)."""
    return sanitised_of(sentences(text), suspect(text))


def sanitised_of(parts: Column, suspect: Column) -> tuple[Column, Column]:
    """sanitised_parts() of a text's sentences() and suspect(), as columns: each is needed more than once."""
    kept = F.when(suspect, F.filter(parts, lambda s: ~injected(s))).otherwise(parts)
    return stripped(F.regexp_replace(F.array_join(kept, " "), CONTROL, "")), suspect & F.exists(parts, lambda s: injected(s))


def sanitised(text: Column) -> Column:
    """T14 as struct(text, flagged)."""
    clean, flagged = sanitised_parts(text)
    return F.struct(clean.alias("text"), flagged.alias("flagged"))


def sanitised_lines(text: Column) -> Column:
    """A Markdown report without hostile lines; line structure stays."""
    return F.array_join(F.transform(F.filter(F.split(text, "\n"), lambda s: ~injected(s)), lambda s: F.regexp_replace(s, CONTROL, "")), "\n")


def follow_up(candidate: Column, question: Column, gap: Column, limit: int = 240) -> Column:
    """The proposed query if it is one harmless line that shares a word with the question or gap, cut at a word; else question and gap."""
    fallback = F.regexp_replace(F.substr(F.array_join(F.filter(F.transform(F.array(question, F.coalesce(F.nullif(gap, F.lit("")), F.lit("补充权威一手证据"))), lambda s: stripped(s)), lambda s: s != ""), " "), F.lit(1), F.lit(limit)), r"\s+$", "")
    raw = stripped(F.coalesce(candidate, F.lit("")))
    shape = (raw == "") | raw.rlike(r"[\r\n]") | raw.rlike(CONTROL) | raw.rlike(ANY_URL) | raw.rlike(f"(?i){ROLE_SYNTAX}") | injected(raw)
    line = squeezed(raw)
    cut = F.regexp_replace(F.substr(line, F.lit(1), F.lit(limit)), r"\s+$", "")
    inside = (F.length(line) > limit) & (F.substr(line, F.lit(limit + 1), F.lit(1)) != " ") & cut.contains(" ")
    bound = F.when(inside, F.regexp_replace(cut, r"\s+\S*$", "")).otherwise(cut)
    anchors = tokens(F.concat(question, F.lit(" "), F.coalesce(gap, F.lit(""))))
    alien = (F.size(anchors) > 0) & ~F.arrays_overlap(anchors, tokens(bound))
    return F.when(shape | (bound == "") | alien, fallback).otherwise(bound)


def normalised_answer(text: Column) -> Column:
    """T27, judging: lower case, all but letters, digits and CJK as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]+", " "))


def normalised_snapshot(text: Column) -> Column:
    """T27, audit: the same with the wider CJK range."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9㐀-鿿]+", " "))


def normalised_query(text: Column) -> Column:
    """T27, sampling: lower case and squeezed."""
    return squeezed(F.lower(text))


def contains_answer(text: Column, answer: Column) -> Column:
    """T28."""
    needle = normalised_snapshot(answer)
    return (needle != "") & normalised_snapshot(text).contains(needle)


def as_question(text: Column) -> Column:
    """Squeezed, with a question mark at its end."""
    t = squeezed(text)
    return F.when(t.rlike(r"[?？]$"), t).otherwise(F.concat(t, F.lit("?")))


def first_sentence(text: Column, limit: int = 220) -> Column:
    """The first sentence, cut at limit with an ellipsis."""
    s = F.coalesce(F.get(sentences(squeezed(text)), 0), F.lit(""))
    return F.when(F.length(s) > limit, F.concat(F.regexp_replace(F.substr(s, F.lit(1), F.lit(limit - 3)), r"\s+$", ""), F.lit("..."))).otherwise(s)


def redacted(text: Column) -> Column:
    """API keys as sk-***."""
    return F.regexp_replace(text, r"sk-[A-Za-z0-9_-]+", "sk-***")
