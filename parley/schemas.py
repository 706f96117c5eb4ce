"""Table schemas and the fixed dimensions of the analysis."""

from __future__ import annotations

from pyspark.sql import types as T

COMMENT = T.StructType(
    [
        T.StructField("conv_id", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("reply_to", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("is_moderator", T.BooleanType()),
        T.StructField("moderation_supported", T.BooleanType()),
        T.StructField("escalated", T.BooleanType()),
        T.StructField("escalation_supported", T.BooleanType()),
        T.StructField("text", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("toxicity", T.DoubleType()),
        T.StructField("severe_toxicity", T.DoubleType()),
        T.StructField("should_intervene", T.DoubleType()),
    ]
)

CONVERSATION_LOOKUP = T.StructType(
    [
        T.StructField("conv_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("dataset", T.StringType()),
    ]
)

# Rating scales of the survey, in questionnaire order.
SCALES = ("positive_reinforcement", "negative_reinforcement", "no_reinforcement")

# Final label codes.
LABELS = {0: "No", 1: "Positive", 2: "Negative", 3: "Both"}
SHORT_LABELS = {0: "No", 1: "Pos", 2: "Neg", 3: "Both"}

# Corpus ids, their display names and modality.
DATASETS = (
    ("ceri", "CeRI", "written"),
    ("wikidisputes", "WikiDisputes", "written"),
    ("wikiconv", "WikiConv", "written"),
    ("umod", "UMOD", "written"),
    ("wikitactics", "WikiTactics", "written"),
    ("cmv_awry", "CMV-Awry", "written"),
    ("fora", "Fora", "spoken"),
    ("iq2", "IQ2", "spoken"),
    ("whow", "WHoW", "spoken"),
)

# Named training groups.
TRAINING_GROUPS = {
    "all": ("ceri", "fora", "wikitactics", "whow", "iq2"),
    "spoken": ("fora", "whow", "iq2"),
    "written": ("ceri", "wikitactics"),
}

# The three wiki sources are one population.
MERGED_SOURCES = {
    "wikidisputes": "wikipedia",
    "wikitactics": "wikipedia",
    "wikiconv": "wikipedia",
}

# Tactics that mark a wiki comment as facilitative.
FACILITATIVE_TACTICS = (
    "Asking questions",
    "Coordinating edits",
    "Providing clarification",
    "Suggesting a compromise",
    "Contextualisation",
)

# Taxonomy, tactic, polarity (+ positive, - negative, blank none).
TACTIC_POLARITY = (
    ("Fora", "Express appreciation", "+"),
    ("Fora", "Express agreement or affirmation", "+"),
    ("Fora", "Open invitation to participants", ""),
    ("Fora", "Specific invitation to participant", ""),
    ("Fora", "Model examples", ""),
    ("Fora", "Follow-up question", ""),
    ("Fora", "Make connections", ""),
    ("WHoW", "Informational", ""),
    ("WHoW", "Coordinative", "-"),
    ("WHoW", "Social", "+"),
    ("WHoW", "Probing", ""),
    ("WHoW", "Confronting", ""),
    ("WHoW", "Instruction", "-"),
    ("WHoW", "Interpretation", ""),
    ("WHoW", "Supplement", ""),
    ("CeRI", "Welcoming", "+"),
    ("CeRI", "Encouragement / appreciation", "+"),
    ("CeRI", "Maintaining civil discourse", "-"),
    ("CeRI", "Explaining why comment not removed", ""),
    ("CeRI", "Indicating irrelevant/off-point comments", "-"),
    ("CeRI", "Pointing to relevant information", ""),
    ("CeRI", "Pointing out effective commenting", "+"),
    ("CeRI", "Asking for more information/sources", ""),
    ("CeRI", "Asking for solutions/alternatives", ""),
    ("CeRI", "Encourage engagement with others", ""),
    ("CeRI", "Pose question to community", ""),
)
