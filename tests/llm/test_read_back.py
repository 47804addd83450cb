"""What is read back from chat ids follows the ids."""

import pytest
from pyspark.sql import functions as F

from spanframe.llm import chat


@pytest.mark.parametrize("role, text, formatted", [
    ("user", "a <s> é", "<s>[INST]a \\1s> é[/INST]"), ("assistant", "\\ 😀", "\\0 😀</s>"), ("system", "", "<s>[SYS][/SYS]"), ("to[ROLE]", "x", "[ROLE]to\\7ROLE][/ROLE]x</s>"),
])
def test_characters_are_those_of_the_ids(spark, role, text, formatted):
    """A token doubled in the emitted ids shows in the characters."""
    out = chat.format_chats(spark.createDataFrame([(1, 0, role, text)], "conv_id int, turn int, role string, text string"))
    assert chat.read_back(out).first().formatted_chars == len(formatted)
    if role == "user":
        piece = len(chat.open_bpe().decoder()[int.from_bytes(out.first().ids[8:12], "little")].decode())
        doubled = out.withColumn("ids", F.expr("concat(substring(ids, 1, 12), substring(ids, 9))"))
        assert chat.read_back(doubled).first().formatted_chars == len(formatted) + piece
