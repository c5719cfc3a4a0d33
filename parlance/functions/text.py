"""Mentions, markdown, relative times and JSON arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mentions by id and by name (fixed patterns).
_ID_MENTION = r"<@!?([0-9]+)>"
_NAME_MENTION = r"@([a-zA-Z0-9_.]+)"


def mentioned_ids(prompt: Column) -> Column:
    """Ids of mentions, each once, as first seen."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(_ID_MENTION), F.lit(1)))


def mentioned_names(prompt: Column) -> Column:
    """Names after an @, without everyone and here. Fires inside id mentions and e-mail addresses too."""
    names = F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(_NAME_MENTION), F.lit(1))
    return F.array_distinct(F.filter(names, lambda x: ~F.lower(x).isin("everyone", "here")))


#: A mention being typed: an @ after a space or at the start, and what follows it to the end (fixed pattern).
_OPEN = r"(^|\s)@([a-zA-Z0-9_.]*)$"


def open_mention(prompt: Column) -> Column:
    """What stands after an @ at the very end; null where no mention is being typed."""
    return F.when(prompt.rlike(_OPEN), F.regexp_extract(prompt, _OPEN, 2))


def insert_mention(prompt: Column, user_id: Column) -> Column:
    """The mention being typed replaced by an id mention and a space."""
    return F.when(prompt.rlike(_OPEN), F.concat(F.regexp_replace(prompt, _OPEN, "$1"), F.lit("<@"), user_id, F.lit("> "))).otherwise(prompt)


#: Inline tokens in order of precedence (fixed patterns); a token ends where its first closing mark stands.
INLINE = {
    "link": r"\[([^\]]+)\]\(([^)]+)\)",
    "code": r"`([^`]+)`",
    "bold": r"\*\*([^*]+)\*\*",
    "italic": r"\*([^*]+)\*",
    "strike": r"~~([^~]+)~~",
}


def inline(text: Column) -> Column:
    """All inline tokens of a text in order, found in one pass: what stands inside one is no other. An array of kind,
    text and href (of links only)."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("|".join(p.replace("(", "(?:").replace(r"\(?:", r"\(") for p in INLINE.values())), F.lit(0))

    def token(hit: Column) -> Column:
        kind, inner = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, pattern in reversed(INLINE.items()):
            fits = hit.rlike(f"^{pattern}$")
            kind = F.when(fits, name).otherwise(kind)
            inner = F.when(fits, F.regexp_extract(hit, f"^{pattern}$", 1)).otherwise(inner)
        return F.struct(kind.alias("kind"), inner.alias("text"), F.when(kind == "link", F.regexp_extract(hit, f"^{INLINE['link']}$", 2)).alias("href"))

    return F.transform(hits, token)


def inline_tokens(text: Column, kind: str) -> Column:
    """The texts of one kind of token."""
    return F.transform(F.filter(inline(text), lambda t: t["kind"] == kind), lambda t: t["text"])


def block_kind(line: Column) -> Column:
    """The class of one line of markdown outside code."""
    return (
        F.when(line.startswith("### "), "h3")
        .when(line.startswith("## "), "h2")
        .when(line.startswith("# "), "h1")
        .when(line.startswith("> "), "quote")
        .when(line.startswith("- ") | line.startswith("* "), "bullet")
        .when(line.rlike(r"^[0-9]+\.\s+"), "number")
        .when(line.rlike(r"^\s*(?:---|\*\*\*)\s*$"), "rule")
        .when(line == "", "blank")
        .otherwise("text")
    )


#: What opens and closes a block of code (fixed value).
FENCE = "```"


def blocks(content: Column) -> Column:
    """SCL24: a message's blocks in order, as an array of kind, text (without marks of its kind), lang (of code), and
    number (of numbered items). What stands between two fences is one block of code, over as many lines as it has;
    its first line, where there are more, names the language. A fence that is never closed is text. Lines outside code
    are a block each."""
    none = F.lit(None).cast("string")
    pieces = F.split(F.coalesce(content, F.lit("")), FENCE, -1)
    last = F.size(pieces) - 1
    # with an odd number of fences the last one opens nothing: its two sides are one piece
    tail = F.concat_ws(FENCE, F.get(pieces, last - 1), F.get(pieces, last))
    odd = last % 2 == 1
    pieces = F.when(odd, F.concat(F.slice(pieces, 1, F.greatest(last - 1, F.lit(0))), F.array(tail))).otherwise(pieces)

    def block(kind: Column, text: Column, lang: Column, number: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("text"), lang.alias("lang"), number.alias("number"))

    def code(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        lang = F.when(cut > 0, F.trim(F.substring_index(piece, "\n", 1))).otherwise("")
        return F.array(block(F.lit("code"), F.when(cut > 0, piece.substr(cut + 1, F.length(piece))).otherwise(piece), lang, none))

    def lines(piece: Column) -> Column:
        return F.transform(F.split(piece, "\n", -1), line)

    def line(text: Column) -> Column:
        kind = block_kind(text)
        marks = F.when(kind == "h3", 4).when(kind == "h2", 3).when(kind.isin("h1", "quote", "bullet"), 2).otherwise(0)
        inner = F.when(kind == "number", F.regexp_extract(text, r"^[0-9]+\.\s+(.*)", 1)).otherwise(text.substr(marks + 1, F.length(text)))
        return block(kind, inner, none, F.when(kind == "number", F.regexp_extract(text, r"^([0-9]+)\.", 1)))

    def one(piece: Column, i: Column) -> Column:
        # a fence alone, with up to two more marks, both begins and ends like code
        bare = piece.isin(FENCE, FENCE + "`", FENCE + "``")
        return F.when(i % 2 == 1, code(piece)).when(bare, code(F.lit(""))).otherwise(lines(piece))

    return F.when(content.isNull() | (content == ""), F.array().cast("array<struct<kind:string,text:string,lang:string,number:string>>")).otherwise(F.flatten(F.transform(pieces, one)))


def relative_time(then_ms: Column, now_ms: Column) -> Column:
    """Just now, Nm, Nh, Yesterday, Nd, or the date."""
    minutes = F.floor((now_ms - then_ms) / 60000).cast("long")
    hours, days = F.floor(minutes / 60).cast("long"), F.floor(minutes / 1440).cast("long")
    return (
        F.when(minutes < 1, "Just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days == 1, "Yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(F.timestamp_millis(then_ms), "MMM d"))
    )


def arguments(text: Column, schema: str) -> Column:
    """Tool arguments out of JSON; a struct of nulls where the text can't be read."""
    return F.from_json(F.coalesce(text, F.lit("{}")), schema, {"mode": "PERMISSIVE"})


def session_title(prompt: Column) -> Column:
    return F.substring(prompt, 1, 30)
