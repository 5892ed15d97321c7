"""What a model is told before each kind of request, as data: a client that talks in messages sends it as the system's."""

from __future__ import annotations

GROUND = "Use only the text you are given. Do not add what you know from elsewhere."
ABSENT = "If the text does not hold the answer, reply NOT_IN_DOCUMENT and nothing else."
CITE = "Name the chunk behind each statement, as in [chunk 3]."
PREMISE = "If the question takes for granted what the text denies, open with FALSE_PREMISE: and the correction on one line."

#: kind of request (the word before the first colon of a prompt) -> what the model is told
PROMPTS = {
    "QUESTION": f"Answer the question. {GROUND} {CITE} {PREMISE} {ABSENT}",
    "EVIDENCE": f"Copy the sentences that bear on the question, word for word, one a line. {GROUND} Without any, reply NONE.",
    "MERGE": f"These are answers to one question from parts of one text. Make one answer of them; keep their citations, and tell where they differ. {PREMISE}",
    "SUMMARISE": f"Summarise what bears on the question, shorter than the text, with its figures. {GROUND}",
    "DRAFT": f"Here is an answer so far and the next part of the text. Give the answer again, bettered by what the part says; leave it as it is if the part adds nothing. {CITE}",
    "SCORE": "Mark how much this part helps to answer the question, from 0 (not at all) to 10 (it answers it). Reply with the number alone.",
    "PLAN": 'Here is the outline of a text. Reply with a JSON object {"read": [...], "skim": [...]} of the numbers of parts to read in full and to skim for the question; parts you leave out are skipped.',
    "STEP": f'Reply with a JSON object {{"can_answer": true or false, "answer": text, "next_query": what to look for next, "quotes": [sentences of the text behind the answer]}}. {GROUND}',
    "FILL": f"Fill the fields of the schema from the text, as a JSON object. Where the text is silent the value is null. Each __quote is the sentence of the text behind its value, word for word. {GROUND}",
    "SCREEN": 'Decide on the opening of a document by the criteria listed. Reply with a JSON object {"decision": "include", "exclude" or "unclear", "criterion": the criterion that excludes it as listed, "reason": one sentence, "quote": the words of the text behind it}.',
    "STATEMENTS": "Rewrite the text as statements that each stand alone, with names in place of pronouns. Reply with a JSON array of strings.",
    "CONTEXT": "Here is the opening of a document and a part of it. Say in one line what the part is about and where in the document it belongs.",
    "CLAIMS": 'Draw the claims that these studies support. Reply with {"claims": [{"claim", "kind": "finding", "method" or "gap", "moderator", "scope", "studies": [ids that support it], "contradicts": [ids against it]}]}.',
    "SAME": 'Which of these claims say the same? Reply with {"groups": [[numbers], ...]}; leave out claims that stand alone.',
    "OUTLINE": 'Group the claims into sections. Reply with {"sections": [{"heading", "brief", "claims": [ids]}]}.',
    "WRITE": "Write this section from its claims. Cite the studies behind each sentence, as in [study 4]; state no number that they do not report.",
    "JOIN": "Join these parts of a section into one, without repeating them; keep every citation.",
    "REVISE": "Revise the text as the pass says. Keep every citation and every number, and make no claim stronger than it was.",
}


def system_prompt(prompt: str) -> str | None:
    """What goes before a prompt, by the word before its first colon."""
    return PROMPTS.get(prompt.partition(":")[0])
