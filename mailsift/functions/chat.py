"""Chat messages, their rendering for a model, and answer-only loss labels."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.functions.text import fill_blank, label_word, mail_text
from mailsift.schemas import CHAT_MESSAGE

# System prompts the classifier was trained and evaluated with.
TRAIN_SYSTEM = (
    "You are a cybersecurity email classifier. "
    "Decide whether the email is phishing or legitimate. "
    "Return exactly one word only: phishing or legitimate."
)
EVAL_SYSTEM = (
    "You are a cybersecurity email classifier. "
    "Decide whether the email is phishing or legitimate. "
    "Do not copy the email. Do not explain. "
    "Output only one label: phishing or legitimate."
)

# Fixed value: the classifier prompt with its two slots.
CLASSIFIER_TEMPLATE = f"System:\n{EVAL_SYSTEM}\n\nUser:\nSubject: {{subject}}\nBody: {{body}}\n"

# Turn marks and texts of the chat format.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>\n"
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
TOOLS_INTRO = (
    "\n\n# Tools\n\nYou may call one or more functions to assist with the user query."
    "\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_OUTRO = (
    "\n</tools>\n\nFor each function call, return a json object with function name and "
    "arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)

# Fixed value: label of a token that takes no part in the loss.
IGNORED = -100


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(
    subject: Column,
    body: Column,
    system: str = TRAIN_SYSTEM,
    label: Column | None = None,
    text: Column | None = None,
) -> Column:
    """System and user message of a mail, and the assistant's answer if a label is given.

    ``text`` replaces the user message, for instance by a shortened one.
    """
    turns = [message("system", F.lit(system))]
    turns.append(message("user", mail_text(subject, body) if text is None else text))
    if label is not None:
        turns.append(message("assistant", label_word(label)))
    return F.array(*turns).cast(f"array<{CHAT_MESSAGE.simpleString()}>")


def _specs(tools: Sequence[dict]) -> str:
    return "".join("\n" + json.dumps(tool, ensure_ascii=False) for tool in tools)


def opening(
    first_role: Column,
    first_content: Column,
    tools: Sequence[dict] = (),
    default_system: str = DEFAULT_SYSTEM,
) -> Column:
    """The system turn every chat starts with, tool specifications included."""
    system = F.when(first_role == "system", fill_blank(first_content)).otherwise(default_system)
    listed = TOOLS_INTRO + _specs(tools) + TOOLS_OUTRO if tools else ""
    return F.concat(F.lit(f"{TURN_START}system\n"), system, F.lit(listed + TURN_END))


def _call(call: Column) -> Column:
    return F.concat(
        F.lit('\n<tool_call>\n{"name": "'),
        call["name"],
        F.lit('", "arguments": '),
        call["arguments"],
        F.lit("}\n</tool_call>"),
    )


def turn_text(
    role: Column,
    content: Column,
    previous_role: Column,
    next_role: Column,
    is_first: Column,
    tool_calls: Column | None = None,
) -> Column:
    """One turn as the model reads it.

    Consecutive tool replies share one user turn, so a reply opens the turn only after
    another role and closes it only before one. A leading system message is already in
    the opening. ``tool_calls`` are ``struct<name, arguments>`` with arguments as JSON.
    """
    content = fill_blank(content)
    framed = F.concat(F.lit(TURN_START), role, F.lit("\n"), content, F.lit(TURN_END))
    reply = F.concat(
        F.when(previous_role.eqNullSafe("tool"), "").otherwise(f"{TURN_START}user"),
        F.lit("\n<tool_response>\n"),
        content,
        F.lit("\n</tool_response>"),
        F.when(next_role.eqNullSafe("tool"), "").otherwise(TURN_END),
    )
    text = F.when((role == "system") & is_first, "")
    if tool_calls is not None:
        calling = F.concat(
            F.lit(f"{TURN_START}assistant"),
            F.when(content != "", F.concat(F.lit("\n"), content)).otherwise(""),
            F.array_join(F.transform(tool_calls, _call), ""),
            F.lit(TURN_END),
        )
        text = text.when((role == "assistant") & (F.size(tool_calls) > 0), calling)
    return (
        text.when(role.isin("system", "user", "assistant"), framed)
        .when(role == "tool", reply)
        .otherwise("")
    )


def render_chat(
    messages: Column,
    add_cue: bool = False,
    tools: Sequence[dict] = (),
    has_tool_calls: bool = False,
    default_system: str = DEFAULT_SYSTEM,
) -> Column:
    """Text of a whole chat held in one ``array<struct<role, content[, tool_calls]>>``."""

    def turn(m: Column, i: Column) -> Column:
        return turn_text(
            m["role"],
            m["content"],
            F.get(messages, i - 1)["role"],
            F.get(messages, i + 1)["role"],
            i == 0,
            m["tool_calls"] if has_tool_calls else None,
        )

    first = F.get(messages, F.lit(0))
    return F.concat(
        opening(first["role"], first["content"], tools, default_system),
        F.array_join(F.transform(messages, turn), ""),
        F.lit(f"{TURN_START}assistant\n" if add_cue else ""),
    )


def answer_only_labels(prompt_ids: Column, full_ids: Column, max_length: int) -> Column:
    """Loss labels of a tokenised chat: its own ids, with the prompt's part ignored.

    Both token arrays are cut to ``max_length`` first. If nothing but ignored labels is
    left, the last token stays trainable.
    """
    ids = F.slice(full_ids, 1, max_length)
    size = F.size(ids)
    hidden = F.least(F.size(F.slice(prompt_ids, 1, max_length)), size)
    ignored = F.lit(IGNORED)
    labels = F.concat(
        F.array_repeat(ignored, hidden), F.slice(ids, hidden + 1, size - hidden)
    )
    last_only = F.concat(F.array_repeat(ignored, size - 1), F.slice(ids, size, F.lit(1)))
    all_ignored = F.forall(labels, lambda x: x == IGNORED)
    return F.when(size == 0, ids).when(all_ignored, last_only).otherwise(labels)
