"""Keyword lists, patterns and substitution tables that results depend on."""

# Fixed values. Case-insensitive whole-word keywords that mark an answer as another assistant's.
SELF_REFERENCE_KEYWORDS = [
    "OpenAI", "Open AI", "ChatGPT", "Chat GPT", "GPT-3", "GPT3", "GPT 3", "GPT-4", "GPT4", "GPT 4",
    "GPT-3.5", "GPT3.5", "GPT 3.5", "BingChat", "Bing Chat", "LAION", "Open Assistant", "OpenAssistant",
]

# Fixed values. Case-insensitive substrings of the older, role-blind keyword filter.
ANY_ROLE_KEYWORDS = [
    "OpenAI", "Open AI", "ChatGPT", "Chat GPT", "GPT-3", "GPT3", "GPT 3", "GPT-4", "GPT4", "GPT 4",
    "GPT-3.5", "GPT3.5", "GPT 3.5", "BingChat", "Bing Chat", "BARD", "Palm", "Anthropic", "Claude",
    "LAION", "Open Assistant", "OpenAssistant",
]

# Fixed values. Model providers whose identity claims are filtered.
PROVIDERS = [
    "OpenAI", "Open AI", "Claude", "Gemini", "Qwen", "DeepSeek", "Anthropic", "Meta AI", "Meta's",
    "ChatGPT", "Cohere", "Mistral AI", "Mistral's", "xAI", "Perplexity",
]

# Fixed values. Identity and policy claims; {P} stands for any provider, {T} for the rest of a sentence.
IDENTITY_PATTERNS = [
    r"\bI'?m\s+({P}),?\s+an?\s+AI\s+(?:assistant|model)[^.!?]{0,100}(?:made|developed|created|trained)\s+by\s+({P})\b{T}",
    r"\b({P})\s+is\s+an?\s+AI\s+(?:assistant|model)[^.!?]{0,100}(?:developed|created|made|trained)\s+by\s+({P})\b{T}",
    r"\bas\s+an?\s+(?:language\s+model|AI\s+model|assistant|chatbot|model)[^.!?]{0,100}\b({P})\b{T}",
    r"\bas\s+an\s+AI\s+(?:developed|created|made|trained)\s+by\s+({P})\b{T}",
    r"\bI\s+am\s+(?:a\s+)?(?:language\s+model|AI\s+model|assistant|chatbot|model)[^.!?]{0,100}\b({P})\b{T}",
    r"\bI\s+am\s+called\s+\b({P})\b{T}",
    r"\b(?:I'?m|I\s+am)\s+\b({P})\b{T}",
    r"\btrained\s+by\s+[^.!?]{0,100}?\b({P})\b{T}",
    r"\bdeveloped\s+by\s+[^.!?]{0,100}?\b({P})\b{T}",
    r"\bcreated\s+by\s+[^.!?]{0,100}?\b({P})\b{T}",
    r"\bmade\s+by\s+[^.!?]{0,100}?\b({P})\b{T}",
    r"\bagainst\s+({P})(?:'s)?\s+(?:use-case\s+)?(?:policy|policies|guidelines|terms){T}",
    r"\b({P})(?:'s)\s+(?:policy|policies|guidelines|terms|use-case){T}",
    r"\bDeepSeek\b{T}",
    r"\bQwen\b{T}",
    r"\bAlibaba\s+Qwen\b{T}",
    r"\bAlibaba\s+Cloud\b{T}",
]
SENTENCE_REST = r"[^.!?]{0,100}[.!?]"


def identity_pattern() -> str:
    alternatives = [
        p.replace("{P}", "|".join(PROVIDERS)).replace("{T}", SENTENCE_REST).replace("(" + "|".join(PROVIDERS), "(?:" + "|".join(PROVIDERS))
        for p in IDENTITY_PATTERNS
    ]
    return "(?i)(?:" + "|".join(alternatives) + ")"


# Fixed value. Mentions of a training cutoff date.
CUTOFF_PATTERN = (
    r"(?i)(?:as\s+(?:of\s+)?(?:my\s+)?(?:last|latest)\s+(?:update|knowledge)(?:\s+was)?\s+in"
    r"|knowledge\s+cutoff|last\s+updated?\s+in)\s+"
    r"(?:(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+)?([0-9]{4})"
)

# Fixed values. Reasoning tags and what replaces them in plain text.
SPECIAL_TOKENS = [("<think>", "\n"), ("</think>", ""), ("<answer>", "\n\n"), ("</answer>", "")]

# Fixed values. Sender names of exported conversations and their roles.
ROLE_NAMES = {
    "gpt": "assistant", "Assistant": "assistant", "assistant": "assistant",
    "user": "user", "User": "user", "human": "user",
}

# Fixed value. Instruction prompt with an input section.
INSTRUCTION_WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides "
    "further context. Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:"
)
