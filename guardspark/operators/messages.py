"""Tokens, messages and streamed answers as Column constructors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "struct<text:string,token_id:int,logprob:float>"
MESSAGE = "struct<role:string,content:string>"
ROLES = ("user", "assistant", "system")


def token(text: Column, token_id: Column | None = None, logprob: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(text.alias("text"), (none if token_id is None else token_id).alias("token_id"), (none if logprob is None else logprob).alias("logprob")).cast(TOKEN)


def message(role: str, content: Column) -> Column:
    if role not in ROLES:
        raise ValueError(f"unknown role {role}")
    return F.struct(F.lit(role).alias("role"), content.alias("content")).cast(MESSAGE)


def answer_chunk(identity: Column, model: Column, tokens: Column, finish_reason: Column | None = None) -> Column:
    """A chunk of a streamed answer: its tokens, and a reason if it is the last."""
    none = F.lit(None).cast("string")
    return F.struct(identity.alias("id"), model.alias("model"), tokens.cast(f"array<{TOKEN}>").alias("tokens"), (none if finish_reason is None else finish_reason).alias("finish_reason"))


def text_of(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["text"]), "")
