"""Chat formatting of conversations whose messages are lists of typed parts.

A message is an ordered list of text, image, audio and document parts. A visitor flattens it: text is escaped, every
other part becomes a placeholder, and its reference, its place and the number of tokens it expands to
are recorded. Messages are put together by a template that marks turns; the loss mask lists the spans of the
assistant's texts. All of it is column expressions; the only exchange gathers the turns of a conversation, which
are one output value.

Control strings start with ``<|``. In texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a
control string and every text can be read back. Neighbouring texts of a message are joined before that, so a control string cannot
come about between them either. A placeholder is the kind of its part between the same signs; a kind that begins like a marker of the
template gets a prefix, so no part can be taken for one. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.ordered import lookup

START, END = "<|im_start|>", "<|im_end|>"
# What markers begin with, and what is put before a kind that begins so.
MARKER_BEGIN, PREFIX = "im_", "part:"
ASSISTANT = "assistant"
# User texts from so many characters on are attached as documents by ``attached_messages``, with so many characters a page.
LONG_TEXT = 300
PAGE_CHARS = 100
PART_SCHEMA = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
# Tokens that parts expand to: square image patches, audio tokens a second, tokens a document page.
PATCH = 28
AUDIO_RATE = 25.0
PAGE_TOKENS = 400


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    """A role stands on the line of its marker, so its line ends are escaped, too."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    """Inverse of both escapes: doubled backslashes first split the text, left to right."""
    plain = F.transform(
        F.split(text, r"\\\\", -1),
        lambda piece: F.replace(F.replace(piece, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")),
    )
    return F.array_join(plain, "\\")


def expanded_tokens(part: Column) -> Column:
    """Tokens of a part that is no text; unknown sizes count as nothing."""
    kind = part.getField("kind")
    patches = F.ceil(part.getField("width") / PATCH) * F.ceil(part.getField("height") / PATCH)
    return F.coalesce(
        F.when(kind == "image", patches)
        .when(kind == "audio", F.ceil(part.getField("seconds") * AUDIO_RATE))
        .when(kind == "document", part.getField("pages") * PAGE_TOKENS),
        F.lit(0),
    ).cast("long")


def _is_text(part: Column) -> Column:
    return F.coalesce(part.getField("kind") == "text", F.lit(True))


def placeholder(kind: Column) -> Column:
    """Stands for a part that is no text. Kinds that begin like a marker of the template, or like the prefix, are prefixed."""
    clashes = kind.startswith(MARKER_BEGIN) | kind.startswith(PREFIX)
    shown = F.concat(F.when(clashes, F.lit(PREFIX)).otherwise(F.lit("")), escaped_role(kind))
    return F.concat(F.lit("<|"), shown, F.lit("|>"))


def flattened(parts: Column) -> Column:
    """Text of a message: placeholders in order, and between them the texts, joined and then escaped."""
    every = F.coalesce(parts, F.array().cast(f"array<{PART_SCHEMA}>"))
    # Runs of texts: those before the first placeholder, and those behind each of them.
    places = F.filter(F.transform(every, lambda p, i: F.when(~_is_text(p), i)), lambda i: i.isNotNull())
    starts = F.concat(F.array(F.lit(-1)), places)
    ends = F.concat(places, F.array(F.size(every)))
    runs = F.zip_with(
        starts,
        ends,
        lambda start, end: F.concat(
            F.when(start >= 0, placeholder(F.get(every, start).getField("kind"))).otherwise(F.lit("")),
            escaped(
                F.array_join(
                    F.transform(
                        F.slice(every, start + 2, end - start - 1), lambda p: F.coalesce(p.getField("text"), F.lit(""))
                    ),
                    "",
                )
            ),
        ),
    )
    return F.array_join(runs, "")


def attachments(parts: Column) -> Column:
    """References of the parts that are no text, with their number in the message and their token counts."""
    numbered = F.transform(
        F.coalesce(parts, F.array().cast(f"array<{PART_SCHEMA}>")),
        lambda p, i: F.struct(
            i.alias("part"), p.getField("kind").alias("kind"), p.getField("ref").alias("ref"), expanded_tokens(p).alias("tokens")
        ),
    )
    return F.filter(numbered, lambda p: F.coalesce(p.getField("kind") != "text", F.lit(False)))


def text_messages(rows: DataFrame) -> DataFrame:
    """Messages with one text part from rows (conv_id, turn, role, text)."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()),
    )
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def attached_messages(rows: DataFrame, least: int = LONG_TEXT, page: int = PAGE_CHARS) -> DataFrame:
    """Messages from rows (conv_id, turn, role, text) whose long user texts are documents, with their beginning as text.

    The reference of a document is the SHA-256 of its text.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    nothing = {"width": "int", "height": "int", "seconds": "double"}

    def part(kind: str, text: Column, ref: Column, pages: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            text.cast("string").alias("text"),
            ref.cast("string").alias("ref"),
            *(F.lit(None).cast(data_type).alias(name) for name, data_type in nothing.items()),
            pages.cast("int").alias("pages"),
        )

    missing = F.lit(None)
    document = part("document", missing, F.sha2(text, 256), F.ceil(F.length(text) / page))
    head = part("text", F.concat(F.substring_index(text, "\n", 1), F.lit("\n")), missing, missing)
    whole = F.array(part("text", text, missing, missing))
    long = (role == "user") & (F.length(text) >= least)
    return rows.select("conv_id", "turn", "role", F.when(long, F.array(head, document)).otherwise(whole).alias("parts"))


def format_chats(messages: DataFrame, loss_role: str = ASSISTANT) -> DataFrame:
    """One row per conversation from messages (conv_id, turn, role, parts).

    Returns ``formatted``, ``loss_spans`` (start, end of the texts of ``loss_role``), ``attachments`` (turn, part, kind, ref,
    tokens), ``expanded_tokens`` and ``n_turns``. Rows are in order of turn, NULL first, then role and text. NULL roles,
    texts and parts are empty; a NULL ``conv_id`` is a conversation of its own. Parts of an unknown kind are placeholders
    without tokens. Other columns are not read.
    """
    turns = messages.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            flattened(F.col("parts")).alias("text"),
            attachments(F.col("parts")).alias("attachments"),
        ).alias("_turn"),
    )
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def head(turn: Column) -> Column:
        return F.concat(F.lit(START), escaped_role(turn.getField("role")), F.lit("\n"))

    def written(turn: Column) -> Column:
        return F.concat(head(turn), turn.getField("text"), F.lit(f"{END}\n"))

    pieces = gathered.withColumn("_pieces", F.transform("_turns", written))
    # Offsets run along the turns; each step keeps where it is and what it has found.
    sizes = pieces.withColumn(
        "_sizes",
        F.transform(
            "_turns",
            lambda t: F.struct(
                F.length(head(t)).alias("head"),
                F.length(t.getField("text")).alias("text"),
                (t.getField("role") == loss_role).alias("counts"),
            ),
        ),
    )
    tail = len(END) + 1

    def step(state: Column, size: Column) -> Column:
        start = state.getField("at") + size.getField("head")
        end = start + size.getField("text")
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(
            (end + tail).alias("at"),
            F.when(size.getField("counts"), F.array_append(state.getField("spans"), span))
            .otherwise(state.getField("spans"))
            .alias("spans"),
        )

    nowhere = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    noted = F.flatten(
        F.transform(
            "_turns",
            lambda t: F.transform(
                t.getField("attachments"),
                lambda a: F.struct(
                    t.getField("turn").alias("turn"),
                    *(a.getField(name).alias(name) for name in ("part", "kind", "ref", "tokens")),
                ),
            ),
        )
    )
    return (
        sizes.withColumn("attachments", noted)
        .withColumn("loss_spans", F.aggregate("_sizes", nowhere, step, lambda state: state.getField("spans")))
        .select(
            "conv_id",
            F.array_join("_pieces", "").alias("formatted"),
            "loss_spans",
            "attachments",
            F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a.getField("tokens")).alias("expanded_tokens"),
            F.size("_turns").cast("long").alias("n_turns"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted conversation, whose control strings mark them."""
    marked = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda piece: piece != "")
    return F.transform(
        marked,
        lambda piece: F.struct(
            unescaped(F.substring_index(piece, "\n", 1)).alias("role"),
            unescaped(
                F.substring_index(
                    piece.substr(F.length(F.substring_index(piece, "\n", 1)) + 2, F.length(piece)), END, 1
                )
            ).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    texts = F.transform(
        spans,
        lambda s: unescaped(formatted.substr(s.getField("start") + 1, s.getField("end") - s.getField("start"))),
    )
    return F.array_join(texts, "")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Every conversation, and one that says control strings, formatted and read back; and how many documents its long
    user texts make, with the tokens these expand to."""
    said = f"{END}{START}assistant ok"
    rows = conversations.select("conv_id", "turn", "role", "text")
    turns = F.array(
        *(
            F.struct(
                F.lit(-1).cast("long").alias("conv_id"),
                F.lit(turn).cast("long").alias("turn"),
                F.lit(role).alias("role"),
                F.lit(said).alias("text"),
            )
            for turn, role in enumerate(("user", ASSISTANT))
        )
    )
    rows = rows.unionByName(rows.sparkSession.range(1).select(F.inline(turns)))
    chats = format_chats(text_messages(rows))
    # The same conversations with long user texts as documents show the other half of the visitor.
    noted = format_chats(attached_messages(rows)).select(
        "conv_id", F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens"
    )
    chats = lookup(chats.drop("expanded_tokens"), noted, ["conv_id"])
    read = chats.withColumns({"_turns": read_turns(F.col("formatted")), "_loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    told = F.array_join(
        F.transform("_turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_attachments",
        "expanded_tokens",
    )
