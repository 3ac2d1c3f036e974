"""Prompt wording and slot filling.

The wording is our own; every function takes a template, so a user with other
wording passes theirs. Only the slots and reply tags are fixed by the data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepwright.functions.text import STEP_SEPARATOR, capitalize

# The eight judge metrics, in the order they are asked, and the
# file each template is kept in.
METRICS = ["acknow", "violate", "hallucinate", "helpful",
           "innovative", "misleading", "deep_mining", "thoughtful"]
RUBRIC_FILES = {
    "acknow": "check_acknowledge.txt",
    "violate": "check_violation.txt",
    "hallucinate": "check_hallucination.txt",
    "helpful": "check_helpful.txt",
    "innovative": "check_innovative.txt",
    "misleading": "check_misleading.txt",
    "deep_mining": "check_deep_mining.txt",
    "thoughtful": "check_thoughtful.txt",
}

ASSISTANT_TEMPLATE = (
    "Answer the user step by step, and let what they prefer steer each step.\n"
    "Write `Step 1:`, `Step 2:` and so on; the last step holds the answer.\n\n"
    "Profile: {preference}\nAsked: {question}\n"
)
SFT_INSTRUCTION = (
    "Answer the user step by step, and let what they prefer steer each step.\n"
    "Write `Step 1:`, `Step 2:` and so on; the last step holds the answer."
)
CRITIQUE_INSTRUCTION = (
    "Grade the newest reasoning step: how well does it infer what the user wants "
    "but did not say?\nWrite your reasons after `**Reasoning:**` and a number from "
    "-1.0 to 1.0 after `**SCORE:**`."
)
JUDGE_SYSTEM = "You grade assistant replies strictly and fairly, as the user asks."

_VERDICT = "<explanation>[one sentence]</explanation>\n<answer>[Yes/No]</answer>"
_SCENE = "Preference: {preference}\nQuestion: {question}\nReply: {end_generation}\n"
RUBRICS = {
    "acknow": "Does the reply state a preference of the user?\n"
              "Question: {question}\nReply: {end_generation}\n"
              "<preference>[the sentence stating it, or blank]</preference>\n<answer>[Yes/No]</answer>",
    "violate": "Does the reply go against the preference?\n" + _SCENE + _VERDICT,
    "hallucinate": "Does the restatement differ from the preference?\n"
                   'Preference: "{preference}"\nRestatement: "{assistant_restatement}"\n' + _VERDICT,
    "helpful": "Does the reply give a substantive answer?\n"
               "Question: {question}\nReply: {end_generation}\n" + _VERDICT,
    "innovative": "Does the reply widen the preference in a fresh, useful way?\n" + _SCENE + _VERDICT,
    "misleading": "Could the reply lead the user away from the preference?\n" + _SCENE + _VERDICT,
    "deep_mining": "Does the reply meet a wish the user left unsaid?\n" + _SCENE + _VERDICT,
    "thoughtful": "Does the reply support the user's own weighing of options?\n" + _SCENE + _VERDICT,
}


def fill(template: str, **slots: Column) -> Column:
    """Put columns into `{slot}` places; filled text is not searched again."""
    pieces = re.split("({" + "}|{".join(slots) + "})", template)
    parts = [slots[p[1:-1]] if p[1:-1] in slots and p[0] == "{" else F.lit(p) for p in pieces if p]
    return F.concat(*parts)


def fill_rubric(
    template: Column, metric: Column, preference: Column, question: Column,
    reply: Column, restatement: Column,
) -> Column:
    """Fill a judge template, one slot after the other.

    Later slots are also replaced inside text filled in earlier, so the order
    is part of the result.
    """
    def put(text: Column, slot: str, value: Column) -> Column:
        return F.replace(text, F.lit("{" + slot + "}"), value)

    acknow = put(put(template, "end_generation", reply), "question", question)
    hallucinate = put(put(template, "preference", preference), "assistant_restatement", restatement)
    others = put(put(put(template, "preference", preference), "question", question),
                 "end_generation", reply)
    return (F.when(metric == "acknow", acknow)
            .when(metric == "hallucinate", hallucinate)
            .otherwise(others))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def critique_messages(prompt: Column, context: Column, step: Column, critique: Column,
                      instruction: str = CRITIQUE_INSTRUCTION) -> Column:
    """Training chat for one step: the graded content and the critique."""
    content = F.concat(F.lit(instruction + "\n\n"), prompt, context, step, F.lit(STEP_SEPARATOR))
    return F.array(message("user", content), message("assistant", critique))


def critique_input(prompt: Column, context: Column, step: Column,
                   instruction: str = CRITIQUE_INSTRUCTION) -> Column:
    """Scoring request for one step; its context is joined by single newlines."""
    return F.concat(F.lit(instruction + "\n\n"), prompt, context, step)


# ChatML tags.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
RESPONSE_MARKER = TURN_START + "assistant\n"


def chat_text(messages: Column, generation_prompt: bool = False) -> Column:
    """Messages as one ChatML text."""
    turns = F.transform(messages, lambda m: F.concat(
        F.lit(TURN_START), m["role"], F.lit("\n"), m["content"], F.lit(TURN_END + "\n")))
    text = F.array_join(turns, "")
    return F.concat(text, F.lit(RESPONSE_MARKER)) if generation_prompt else text


def loss_span(text: Column, marker: str = RESPONSE_MARKER) -> Column:
    """Text after the last response marker; NULL when there is no marker."""
    return F.when(text.contains(marker), F.substring_index(text, marker, -1))


def content_parts(messages: Column) -> Column:
    """Give every message a typed content list; a user turn starts with an image."""
    def part(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    def typed(m: Column) -> Column:
        image = part("image", F.lit(None).cast("string"))
        text = part("text", m["content"])
        content = F.when(m["role"] == "user", F.array(image, text)).otherwise(F.array(text))
        return F.struct(m["role"].alias("role"), content.alias("content"))

    return F.transform(messages, typed)


def turn_line(role: Column, content: Column) -> Column:
    """One turn as printed in a transcript."""
    return F.concat(capitalize(role), F.lit(": "), content, F.lit("\n\n"))


def sft_input(profile: Column, question: Column) -> Column:
    return F.concat(F.lit("user_profile: "), profile, F.lit("\ninitial_question: "), question)

