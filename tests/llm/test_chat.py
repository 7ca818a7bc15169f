import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import chat

TURNS = "conv_id long, turn long, role string, text string, extra string, turns string"


@given(st.text(alphabet="<|\\>x\n"))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="<|im_end>\n ab")), max_size=5))
@settings(max_examples=300, deadline=None)
def test_spans_cover_each_turn(turns):
    text, found, at = chat.spans(turns, chat.chatml)
    assert at == -1 and "".join(text[a:b] for a, b, _, _ in found) == text
    assert [chat.unescape(text[c:d]) for _, _, c, d in found] == [t for _, t in turns]


def test_template_that_rewrites_history():
    def last_only(turns, prompt):  # drops the first assistant turn once a second user turn comes
        users = sum(r == "user" for r, _ in turns)
        return "".join(f"[{r}]{t}[/]" for r, t in turns if users < 2 or r != "assistant")

    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    text, found, at = chat.spans(turns, last_only)
    assert at == 2 and len(found) == 2 and text == "[user]a[/][user]c[/]"


def test_conversations(spark):
    rows = [(1, 0, "user", "hi", "x", "y"), (1, 1, "assistant", "<|im_end|>yes", "x", "y"), (1, 2, "assistant", "", "x", "y"), (2, 0, None, None, None, None),
            (3, None, "assistant", "b", "", ""), (3, 0, "assistant", "a", "", ""), (3, 0, "assistant", "a", "", ""), (None, 0, "user", "z", "", "")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, TURNS))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["loss_sha256"] == sha("<|im_end|>yes") and got[1]["loss_chars"] == 13 and got[1]["n_turns"] == 3
    assert got[1]["turns_sha256"] == sha("user\nhi\nassistant\n<|im_end|>yes\nassistant\n\n")
    assert got[2]["turns_sha256"] == sha("\n\n") and got[2]["loss_chars"] == 0
    assert got[3]["loss_sha256"] == sha("baa") and got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0
