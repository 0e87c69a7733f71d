"""Prompt texts and task tables. Results depend on their exact wording."""

PREAMBLE = "Below is an instruction that describes a task. Write a response that appropriately completes the request."

JUDGE = """
You are a fair judge. Evaluate the model response against the reference answer using the rubric below.

Rubric:
1: Fails to address instructions; irrelevant or incorrect.
2: Partially addresses instructions; significant inaccuracies or irrelevant details.
3: Follows instructions with minor inaccuracies or unnecessary details.
4: Clear, accurate, and relevant with only minor issues.
5: Fully adheres to instructions; concise, accurate, and complete.

Instruction: {instruction}
Reference Answer: {reference}
Model Response: {answer}

Output format: Provide a one-sentence evaluation and an integer score (1-5).
Feedback: (one-sentence rationale)
Score: (integer 1-5)"""

TASKS_ALONE = {
    "factual_lookup": "a short factual question about science, history, or geography (e.g. 'What is the capital of Japan?')",
    "definition": "ask to define a specific term or concept (e.g. 'Define the term ecosystem.')",
    "list_generation": "ask to list or name N specific examples of something (e.g. 'Name three types of biomes.')",
    "calculation": "a concrete math or unit conversion problem with specific numbers (e.g. 'Convert 45 kilometers to meters.')",
    "formula_lookup": "ask for a specific scientific or mathematical formula (e.g. 'What is the formula for the area of a triangle?')",
    "verb_form": "ask for a specific grammatical form of a word (e.g. 'What is the past tense of draw?')",
    "word_relationship": "ask for a synonym, antonym, or rhyme for a specific word (e.g. 'Provide a synonym for bright.')",
}
TASKS_WITH_INPUT = {
    "grammar_correction": "grammar or spelling correction of a sentence",
    "voice_conversion": "converting a sentence between active and passive voice",
    "tense_conversion": "rewriting a sentence in a different verb tense",
    "translation": "translating a short phrase into another language",
    "sentence_rewriting": "rewriting a sentence using a figurative device such as a metaphor, simile, or idiom",
    "sentiment_analysis": "sentiment analysis of a short text (positive, negative, or neutral)",
    "sorting": "sorting a short list of items alphabetically or numerically",
    "redundancy_removal": "removing redundant or unnecessary words from a sentence",
    "formality_adjustment": "rewriting a sentence to be more formal or more informal",
    "text_classification": "classifying a word or short phrase into a given set of categories",
}
MODE_WEIGHTS = {"A": 0.7, "B": 0.3}

ASK_ALONE = """\
Generate a single instruction of type: {task_description}.

Rules:
- Output ONLY the instruction itself — no preamble, no quotes, no explanation.
- Keep it concise (one sentence, under 20 words).
- Make it specific and concrete, not generic.
"""
ASK_WITH_INPUT = """\
Generate a transformation task of type: {task_description}.

Provide:
  "instruction": a short imperative instruction (e.g. "Edit the following sentence for grammar.")
  "input": the specific text the instruction should be applied to (a sentence, list, or phrase)

Rules:
- The instruction must NOT contain the input text — keep them separate.
- Keep both fields concise.
"""
INPUT_SCHEMA = {"type": "object", "properties": {"instruction": {"type": "string"}, "input": {"type": "string"}}, "required": ["instruction", "input"]}

RESPONSE_SYSTEM = "You are a helpful, precise but picky assistant for checking the quality of the answer to a given instruction."
INSTRUCTION_SYSTEM = "You are a helpful, precise but picky assistant for checking the quality of a given instruction."

RESPONSE_TASK = """1. Why is this answer not good? Analyse based on Helpfulness, Relevance, Accuracy, and Level of Details.
2. Based on the reason you provided, generate a better answer, new and complete, as detailed as possible.

Format your better answer exactly as: [Better Answer] your answer [End]

IMPORTANT:
- Do NOT repeat your answer or continue writing after [End]."""

RESPONSE_EXAMPLE = """Here is an example of the expected output format:

[Instruction]
Convert 45 kilometers to meters.

[The Start of Answer]
45 kilometers is equal to 45,000 meters.
[The End of Answer]

1. Why is this answer not good? Analyse based on Helpfulness, Relevance, Accuracy, and Level of Details.

- **Helpfulness:** The answer is helpful in that it provides the correct conversion.
- **Relevance:** The answer is relevant to the instruction, as it directly addresses the conversion requested.
- **Accuracy:** The answer is accurate; 45 kilometers does indeed equal 45,000 meters.
- **Level of Details:** The answer lacks detail. It does not explain the conversion process or provide any context, which could be beneficial for someone unfamiliar with metric conversions.

2. Based on the reason you provided, generate a better answer:

[Better Answer] To convert 45 kilometers to meters, we use the fact that 1 kilometer equals 1,000 meters. Therefore, 45 kilometers x 1,000 = 45,000 meters. This conversion is based on the metric system, where the prefix "kilo-" always means 1,000 of the base unit. [End]"""

INSTRUCTION_TASK = """We would like you to evaluate and improve the quality of the instruction.

1. Evaluate the instruction on:
   - **Complexity:** Is the topic trivial or does it require deeper knowledge?
   - **Clarity:** Is the instruction clear and unambiguous?
   - **Detail requirement:** Does it ask for enough detail to produce a thorough answer?
   - **Reasoning:** Does it require problem-solving or just recall?

2. Explain why the current instruction could lead to a shallow or suboptimal answer.

3. Generate a new, improved instruction that:
   - Is more complex and thought-provoking
   - Is self-contained (answerable without external context)
   - Would lead to a more detailed, higher-quality answer

4. Provide a detailed response to your new instruction.
    """

INSTRUCTION_EXAMPLE = """Here is an example of the expected output format:

[Instruction]
What is the capital of France?

[The Start of Answer]
Paris.
[The End of Answer]

1. Evaluation:
- **Complexity:** Very low — this is a simple factual recall question.
- **Clarity:** Clear and unambiguous.
- **Detail requirement:** None — it only asks for a single fact.
- **Reasoning:** Pure recall, no problem-solving.

2. The current instruction leads to a one-word answer with no depth. It does not ask the learner to think critically or demonstrate understanding.

3-4. Improved instruction and answer:

[New Instruction] Explain Paris's historical, political, and cultural significance as the capital of France, including how its role has evolved from the medieval period to the present day. [End]
[New Answer] Paris has served as the capital of France since the late 10th century when Hugh Capet, the first Capetian king, established it as his seat of power. Historically, the city grew around the Île de la Cité on the Seine, benefiting from its strategic position for trade and defense. During the medieval period, Paris became a center of learning with the founding of the University of Paris (c. 1150), one of Europe's earliest universities. Politically, Paris has been the epicenter of major events including the French Revolution (1789), which transformed France from an absolute monarchy into a republic. The city housed the National Assembly and became synonymous with democratic ideals. Culturally, Paris earned its reputation as the "City of Light" during the Enlightenment and later as a hub for art movements including Impressionism and Existentialism. Today, Paris serves as France's administrative capital, hosting the Élysée Palace (presidency), the National Assembly, and the Senate, while remaining a global center for fashion, gastronomy, and diplomacy. [End]"""

INSTRUCTION_RULES = """Now do the same for the following. You MUST use the exact tags [New Instruction], [New Answer], and [End] as shown in the example above. Do NOT wrap these tags in markdown bold (**) or any other formatting.

Format your output exactly as:
[New Instruction] your improved instruction [End]
[New Answer] your detailed answer to the new instruction [End]

IMPORTANT:
- Use the EXACT tags: [New Instruction], [New Answer], and [End] — no markdown, no bold, no extra brackets.
- Do NOT repeat or continue writing after the final [End]."""
