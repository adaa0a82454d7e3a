"""Word lists, weights, bounds, prices and patterns.

Everything in this module is a fixed value: results depend on these exact
strings and numbers, so they are stated plainly and in their natural order.
"""

# --- fixed values: tiers -----------------------------------------------------
TIERS = ["trivial", "light", "moderate", "heavy", "intensive", "extreme"]
TIER_MIDPOINTS = {"trivial": 0.04, "light": 0.13, "moderate": 0.25,
                  "heavy": 0.42, "intensive": 0.62, "extreme": 0.86}
RETRIEVAL_TIER_VALUES = {"trivial": 0.05, "light": 0.15, "moderate": 0.30,
                         "heavy": 0.50, "intensive": 0.70, "extreme": 0.90}
CLASSIC_BOUNDS = [0.08, 0.18, 0.32, 0.52, 0.72]
CALIBRATED_BOUNDS = [0.1557, 0.1842, 0.2788, 0.3488, 0.4611]
LABEL_BOUNDS = [0.10, 0.20, 0.35, 0.50, 0.65]

FEATURE_NAMES = [
    "sentence_count", "avg_word_length", "has_question", "question_technical",
    "technical_design", "code", "architecture", "word_count",
    "four_plus", "has_imperative", "technical_terms", "multi_step",
    "requires_context", "domain_specificity", "ambiguity_score",
]
DEFAULT_WEIGHTS = {
    "sentence_count": 0.29, "avg_word_length": 0.19, "has_question": 0.12,
    "question_technical": 0.05, "technical_design": 0.12, "code": 0.10,
    "architecture": 0.07, "word_count": 0.00, "four_plus": 0.00,
    "has_imperative": 0.06, "technical_terms": 0.00, "multi_step": 0.00,
    "requires_context": 0.00, "domain_specificity": 0.00, "ambiguity_score": 0.00,
}

# --- fixed values: cascade weights (intercept, then FEATURE_NAMES order) ------
CASCADE_TIERS = TIERS[:5]
CASCADE_WEIGHTS = {
    "trivial": (-1.42, [1.8, -2.1, 5.29, -0.5, -0.3, -0.4, -0.01, -0.2, -1.5, -3.77,
                        -1.0, -0.3, -0.05, 8.24, -18.74]),
    "light": (0.35, [1.2, -0.8, -5.84, -1.5, -0.4, 1.1, -3.0, 0.5, 0.8, 0.6,
                     0.3, 0.6, 2.92, -7.11, 7.39]),
    "moderate": (-0.15, [0.4, 0.3, -1.33, -0.5, 0.2, 0.8, -0.57, 0.6, 0.5, -0.26,
                         0.4, 0.7, -0.97, 1.61, -0.9]),
    "heavy": (0.05, [0.3, 0.2, -0.01, 0.1, 0.4, 0.6, -0.81, 0.7, 0.5, -0.43,
                     0.5, -0.81, -0.8, -0.56, 1.01]),
    "intensive": (-0.1, [0.5, 0.4, -1.01, -0.3, 0.6, 0.5, -0.27, 0.8, 0.6, 0.33,
                         0.7, 0.9, -0.75, 0.58, -1.24]),
}

# --- fixed values: prompt feature word lists ---------------------------------
TECH_WORDS = [
    "api", "http", "rest", "graphql", "websocket", "dns", "ssl", "tls",
    "oauth", "jwt", "cors", "cdn", "docker", "kubernetes", "git",
    "json", "yaml", "xml", "sql", "nosql", "redis", "mongodb",
    "typescript", "python", "rust", "java", "react", "vue", "angular",
    "svelte", "node", "express", "fastapi", "function", "class",
    "async", "await", "error", "type", "interface", "architecture",
    "design", "system", "microservice", "container", "deploy", "pipeline",
    "algorithm", "database", "refactor", "optimize", "debug", "security",
]
ARCH_PHRASES = [
    "architecture", "design pattern", "system design", "microservice",
    "distributed", "scalable", "load balancer", "event-driven", "service mesh",
    "api gateway", "serverless", "cloud-native", "infrastructure",
]
DESIGN_PHRASES = [
    "technical design", "implementation plan", "migration strategy",
    "deployment strategy", "disaster recovery", "failover",
]
IMPERATIVES = [
    "read", "summarize", "format", "explain", "add", "rename", "write",
    "check", "count", "find", "replace", "show", "make", "fix",
    "extract", "parse", "validate", "sort", "filter", "calculate",
    "create", "build", "run", "test", "implement", "refactor",
    "optimize", "deploy", "configure",
]
VAGUE_WORDS = ["something", "stuff", "thing", "things", "it", "this", "that"]

# dataset-factory variant
SAMPLE_TECH_WORDS = [
    "api", "http", "rest", "graphql", "websocket", "dns", "ssl", "tls",
    "oauth", "jwt", "cors", "cdn", "docker", "kubernetes", "git",
    "json", "yaml", "xml", "csv", "sql", "nosql", "redis", "mongodb",
    "postgresql", "mysql", "typescript", "python", "rust", "java", "golang",
    "react", "vue", "angular", "svelte", "node", "express", "fastapi",
    "function", "class", "async", "await", "error", "type", "interface",
    "architecture", "design", "system", "microservice", "container",
    "deploy", "pipeline", "ci/cd", "agile", "scrum",
    "algorithm", "data structure", "big o", "complexity",
    "security", "authentication", "authorization", "encryption",
    "database", "cache", "queue", "broker", "proxy", "gateway",
    "refactor", "migrate", "optimize", "benchmark", "profile",
    "debug", "trace", "log", "monitor", "alert",
]
SAMPLE_ARCH_PHRASES = [
    "architecture", "design pattern", "system design", "microservice",
    "distributed", "scalable", "high availability", "load balancer",
    "event-driven", "message queue", "service mesh", "api gateway",
    "monolith", "serverless", "cloud-native", "infrastructure",
]
SAMPLE_DESIGN_PHRASES = [
    "technical design", "implementation plan", "migration strategy",
    "deployment strategy", "release plan", "rollback plan",
    "capacity planning", "disaster recovery", "failover",
]
SAMPLE_IMPERATIVES = [
    "read", "summarize", "format", "explain", "add", "rename", "write",
    "check", "count", "find", "replace", "show", "make", "fix", "extract",
    "parse", "validate", "sort", "filter", "group", "calculate",
    "deduplicate", "reverse", "split", "join", "trim", "lowercase",
    "uppercase", "capitalize", "list", "define", "tell", "give",
    "convert", "spell", "say", "help", "create", "build", "run",
    "test", "compile", "install", "update", "delete", "remove",
    "implement", "refactor", "optimize", "deploy", "configure",
    "set up", "integrate", "migrate", "debug", "trace",
]
SAMPLE_VAGUE_WORDS = VAGUE_WORDS + ["whatever"]

# feedback variant
FEEDBACK_TECH_WORDS = [
    "api", "http", "rest", "graphql", "docker", "kubernetes", "git",
    "typescript", "python", "rust", "react", "node", "server",
    "database", "function", "class", "async", "await", "error",
    "architecture", "design", "system", "microservice",
]
FEEDBACK_ARCH_PHRASES = ["architecture", "design pattern", "system design", "microservice"]
FEEDBACK_DESIGN_PHRASES = ["technical design", "implementation plan", "migration strategy"]
FEEDBACK_IMPERATIVES = [
    "read", "summarize", "format", "explain", "add", "rename", "write",
    "check", "find", "replace", "show", "make", "fix", "extract", "parse",
    "validate", "sort", "filter", "calculate", "create", "build", "run",
    "test", "implement", "refactor", "optimize", "deploy", "configure",
]

# generator variant
GENERATOR_TECH_WORDS = [
    "api", "http", "json", "sql", "docker", "git", "kubernetes",
    "typescript", "python", "react", "node", "server", "database",
    "function", "class", "async", "await", "error", "type",
]
GENERATOR_CODE_MARKERS = ["```", "`", "def ", "const ", "function ", "class ", "import "]
GENERATOR_INTERROGATIVES = ["what", "how", "when", "where", "who", "why", "which",
                            "is", "are", "can", "do", "does"]
GENERATOR_IMPERATIVES = [
    "read", "summarize", "format", "explain", "add", "rename", "write",
    "check", "count", "find", "replace", "show", "make", "fix", "extract",
    "parse", "validate", "sort", "filter", "group", "calculate",
    "deduplicate", "reverse", "split", "join", "trim", "lowercase",
    "uppercase", "capitalize", "list", "define", "tell", "give",
    "convert", "spell", "say", "help",
]
GENERATOR_LANGUAGE_MARKERS = [
    ("python", ["def ", "import ", "print(", "python"]),
    ("typescript", ["const ", "=>", "function ", "typescript"]),
    ("rust", ["fn ", "let mut", "impl ", "rust"]),
    ("go", ["func ", "go ", "package "]),
    ("sql", ["select ", "from ", "where "]),
]

# --- fixed values: nine signals ----------------------------------------------
SIGNAL_IMPERATIVES = ["write", "create", "build", "implement", "generate", "fix",
                      "debug", "optimize", "explain", "analyze", "describe", "design"]
SIGNAL_CODE = ["code", "function", "def ", "class ", "import ", "fn ", "const "]
SIGNAL_SEQUENCE = ["first ", "then ", "finally", "step ", "part ", "section ", "also "]
SIGNAL_CONSTRAINT = ["must ", "should ", "required ", "only ", "cannot ", "limit "]
SIGNAL_CONTEXT = ["given ", "consider ", "assume ", "suppose ", "based on ", "according to "]
SIGNAL_ARCHITECTURE = ["architecture", "design pattern", "system design", "microservice",
                       "scalable", "distributed"]
SIGNAL_DESIGN = ["technical design", "implementation plan", "migration strategy",
                 "deployment", "pipeline", "schema", "database"]
SYSTEM_WORDS = [
    "distributed", "microservice", "event sourcing", "cqrs",
    "federated", "zero-knowledge", "zkp", "zk-proof", "blockchain",
    "multi-region", "multi-tenant", "load balanc", "service mesh",
    "message queue", "kafka", "redis", "elasticsearch",
    "ci/cd", "kubernetes", "docker", "terraform",
    "websocket", "grpc", "graphql", "rest api",
    "authentication", "authorization", "encryption",
    "observability", "monitoring", "tracing",
    "failover", "disaster recovery", "backup",
    "real-time", "streaming", "batch processing",
    "autonomous", "self-healing", "asic", "fine-tuning",
    "custom hardware", "acceleration", "inference",
]
# label formula lists
LABEL_CODE = ["code", "function", "def ", "class ", "import ", "``", "fn ", "const "]
LABEL_SEQUENCE = ["first ", "then ", "finally", "step ", "part ", "section ", "also ", "and also"]
LABEL_CONSTRAINT = ["must ", "should ", "required ", "only ", "don't", "cannot ", "limit ",
                    "maximum ", "minimum "]
LABEL_CONTEXT = ["given ", "consider ", "assume ", "suppose ", "based on ", "according to ",
                 "using the ", "from the ", "in the context "]

# --- fixed values: gateway feature lists -------------------------------------
DOMAIN_WORDS = {
    "finance": ["wacc", "ebitda", "balance sheet", "cash flow", "npv", "irr",
                "capm", "beta", "dividend", "hedge", "derivative", "amortization",
                "liquidity", "solvency", "leverage", "revenue", "margin", "forecast"],
    "legal": ["gdpr", "hipaa", "liability", "indemnification", "compliance",
              "contract", "clause", "jurisdiction", "arbitration", "regulation",
              "statute", "litigation", "deposition", "affidavit"],
    "medical": ["clinical trial", "diagnosis", "treatment", "pharmacology",
                "icd-10", "pathology", "biomarker", "prognosis", "dosage",
                "contraindication", "adverse effect", "therapeutic"],
    "engineering": ["load bearing", "tolerance", "fatigue", "stress analysis",
                    "finite element", "computational fluid", "thermodynamic",
                    "structural", "material science", "kinematics"],
}
NEGATION_WORDS = ["don't", "not", "never", "avoid", "without", "except", "unless", "nor"]
EXPERT_WORDS = ["paradigm", "idempotent", "orthogonal", "monotonic", "isomorphic",
                "polymorphic", "asymptotic"]
ENTITY_COMPANY = r"[A-Z][a-z]+ (?:Inc|Corp|LLC|Ltd|Co|GmbH|SA|PLC)"
ENTITY_MONEY = r"\$[0-9]+(?:\.[0-9]+)?[MKB]?"
ENTITY_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
TEMPORAL = (r"by tomorrow|by next week|within [0-9]+|last quarter|Q[0-9]|deadline|urgent|asap|"
            r"immediately|by end of")
OUTPUT_FORMAT = (r"as (?:json|yaml|xml|csv|markdown|table|list)|in (?:json|yaml|xml|csv)|"
                 r"format (?:as|like)|output (?:as|format)")
PRIOR_CONTEXT = (r"as we discussed|as mentioned|continue|from before|previous|the file|"
                 r"this project|my code|our system|given that|as before")
STOP_PREFIXES = ["the", "and", "for", "with", "this", "that", "from", "have", "been"]
STOP_PREFIXES_LONG = STOP_PREFIXES + [
    "were", "their", "there", "about", "would", "could", "should", "which", "other",
    "these", "some", "what", "when", "where", "who", "will", "each", "make", "just",
    "like", "than", "them", "very", "only", "after", "before", "between", "under",
    "while", "after", "through", "during"]

# --- fixed values: routes ----------------------------------------------------
# tier, model, provider, max_tokens
DEFAULT_ROUTES = [
    ("trivial", "glm-4.5-air", "zai", 256),
    ("light", "glm-4.7-flash", "zai", 512),
    ("moderate", "glm-4.7", "zai", 1024),
    ("heavy", "glm-5.1", "zai", 2048),
    ("intensive", "qwen3.6-plus", "bailian", 4096),
    ("extreme", "qwen3.6-plus", "bailian", 8192),
]
# tier, model, provider, max_tokens, thinking, ordered fallbacks
GATEWAY_ROUTES = [
    ("trivial", "glm-4.5-air", "zai", 256, False,
     [("glm-4.7-flash", "zai"), ("glm-4.7", "zai"), ("kimi-k2.5", "bailian")]),
    ("light", "glm-4.7-flash", "zai", 512, False,
     [("glm-4.7", "zai"), ("glm-4.5-air", "zai"), ("MiniMax-M2.5", "bailian")]),
    ("moderate", "MiniMax-M2.5", "bailian", 2048, False,
     [("qwen3.5-plus", "bailian"), ("kimi-k2.5", "bailian"), ("glm-4.7-flash", "zai")]),
    ("heavy", "qwen3.5-plus", "bailian", 4096, True,
     [("qwen3.6-plus", "bailian"), ("MiniMax-M2.5", "bailian"), ("glm-4.7-flash", "zai"),
      ("glm-4.7", "zai")]),
    ("intensive", "qwen3.5-plus", "bailian", 4096, True,
     [("qwen3.6-plus", "bailian"), ("kimi-k2.5", "bailian"), ("MiniMax-M2.5", "bailian")]),
    ("extreme", "qwen3.6-plus", "bailian", 8192, True,
     [("qwen3.6-max-preview", "bailian"), ("qwen3.5-plus", "bailian"), ("kimi-k2.5", "bailian")]),
]
# profile -> model per tier, in TIERS order
AGENT_PROFILES = {
    "cost-optimized": ["qwen3.5-plus", "glm-4.7-flash", "qwen3-coder-plus", "qwen3.6-plus",
                       "qwen3.5-plus", "qwen3.6-plus"],
    "quality": ["qwen3.5-plus", "glm-4.7-flash", "qwen3-coder-plus", "qwen3.6-plus",
                "qwen3.5-plus", "qwen3.6-plus"],
    "balanced": ["qwen3.5-plus", "qwen3.5-plus", "qwen3-coder-plus", "qwen3.6-plus",
                 "qwen3.5-plus", "qwen3.6-plus"],
    "benchmark": ["openrouter/owl-alpha", "openrouter/z-ai/glm-4.7-flash",
                  "openrouter/qwen/qwen-plus", "openrouter/google/gemini-2.5-flash",
                  "openrouter/anthropic/claude-sonnet-4.6",
                  "openrouter/anthropic/claude-opus-4.6"],
}
# model, input and output USD per million tokens
PRICING = [
    ("openrouter/owl-alpha", 0.0, 0.0), ("minimax/minimax-m2.5:free", 0.0, 0.0),
    ("qwen/qwen3-coder:free", 0.0, 0.0), ("z-ai/glm-4.5-air:free", 0.0, 0.0),
    ("meta-llama/llama-3.3-70b-instruct:free", 0.0, 0.0),
    ("z-ai/glm-4.7-flash", 0.06, 0.40), ("google/gemini-2.5-flash-lite", 0.10, 0.40),
    ("deepseek/deepseek-v4-flash", 0.14, 0.28),
    ("qwen/qwen-plus", 0.26, 0.78), ("qwen/qwen3.5-plus-02-15", 0.26, 1.56),
    ("minimax/minimax-m2.5", 0.15, 1.15), ("google/gemini-2.5-flash", 0.30, 2.50),
    ("anthropic/claude-sonnet-4.6", 3.00, 15.00), ("anthropic/claude-haiku-4.5", 1.00, 5.00),
    ("openai/o4-mini", 1.10, 4.40),
    ("anthropic/claude-opus-4.6", 5.00, 25.00), ("anthropic/claude-opus-4.7", 5.00, 25.00),
    ("openai/gpt-5.5", 5.00, 30.00),
]
BASELINE_MODEL = "anthropic/claude-opus-4.6"
UNIT_COSTS = [("trivial", 0.0), ("light", 0.0005), ("moderate", 0.0007),
              ("heavy", 0.0005), ("intensive", 0.0420), ("extreme", 0.0700)]
BASELINE_UNIT_COST = 0.075
MAX_COST_PER_MESSAGE = [("trivial", 0.0), ("light", 0.0010), ("moderate", 0.0050),
                        ("heavy", 0.0100), ("intensive", 0.0500), ("extreme", 0.1000)]
ACCURACY_ALERTS = [("trivial", 0.99), ("light", 0.90), ("moderate", 0.35),
                   ("heavy", 0.30), ("intensive", 0.15), ("extreme", 0.60)]
COST_ALERT = 0.020
ESCALATION_ALERT = 0.20
ENSEMBLE_WEIGHTS = {"heuristic": 0.55, "cascade": 0.0, "retrieval": 0.25, "history": 0.20}
PROBABILITY_GATES = [("trivial", 0.95), ("light", 0.90), ("moderate", 0.80), ("heavy", 0.75)]
DOWNGRADE_GATES = [("trivial", 0.3), ("light", 0.4), ("moderate", 0.5), ("heavy", 0.6),
                   ("intensive", 0.7)]
ADEQUACY_TOKEN_RANGES = [("trivial", 5, 50), ("light", 20, 200), ("moderate", 100, 800),
                         ("heavy", 300, 2000), ("intensive", 500, 4000), ("extreme", 1000, 8000)]
RETRYABLE_STATUS = ["429", "1305", "1308", "timeout"]

# --- fixed values: conversation budgets --------------------------------------
CONTEXT_WINDOWS = [
    ("qwen3.5-plus", 1000000), ("qwen3.6-plus", 1000000), ("qwen3-coder-plus", 1000000),
    ("qwen3.6-max-preview", 1000000), ("qwen4.6", 1000000),
    ("glm-4.5-air", 200000), ("glm-4.7-flash", 200000), ("glm-4.7", 200000),
    ("glm-5", 200000), ("glm-5-turbo", 200000), ("glm-5.1", 204800), ("glm-5v-turbo", 200000),
    ("openrouter/owl-alpha", 1048756), ("openrouter/glm-4.7-flash", 202752),
    ("openrouter/qwen-plus", 1000000), ("openrouter/gemini-2.5-flash", 1048576),
    ("openrouter/claude-sonnet-4.6", 1000000), ("openrouter/claude-opus-4.6", 1000000),
]
DEFAULT_WINDOW = 200000
KV_BYTES_PER_1K = [
    ("qwen3-coder-plus", 1024000), ("qwen3.6-plus", 512000), ("qwen3.5-plus", 256000),
    ("glm-5.1", 320000), ("glm-4.7", 160000), ("glm-4.7-flash", 128000), ("glm-4.5-air", 96000),
]
DEFAULT_KV_BYTES = 128000
TOPIC_GROUPS = [
    ("code", ["function", "class", "def ", "import ", "const ", "let ", "var ",
              "interface", "type ", "enum ", "async", "await", "return", "export"]),
    ("architecture", ["architecture", "design pattern", "system design", "microservice",
                      "scalable", "distributed", "event sourcing", "cqrs", "kafka"]),
    ("infra", ["kubernetes", "docker", "terraform", "ci/cd", "deployment", "pipeline",
               "load balanc", "service mesh", "message queue"]),
    ("security", ["authentication", "authorization", "encryption", "zero-knowledge",
                  "zkp", "oauth", "jwt", "rbac", "permissions"]),
    ("data", ["database", "schema", "migration", "query", "index", "cache",
              "redis", "elasticsearch", "postgresql"]),
    ("decision", ["decision", "conclusion", "therefore", "resolved", "agreed",
                  "final", "must", "required"]),
    ("error", ["error", "failed", "exception", "timeout", "crash", "bug"]),
]
DECISION_WORDS = ["decision", "conclusion", "therefore", "resolved", "agreed", "final"]
ERROR_WORDS = ["error", "failed", "exception", "timeout"]
KEY_FACT_WORDS = DECISION_WORDS + ["error", "failed"]
RUN_SEPARATOR = "\n---\n"
CONTINUE_TEXT = "[Continuing conversation — please respond]"

# --- fixed values: corpus scan -----------------------------------------------
SCAN_EXCLUDED_DIRS = ["node_modules", ".git", "coverage", "__pycache__"]
SCAN_BINARY_SUFFIXES = [".png", ".jpg", ".gif", ".ico", ".exe", ".dll", ".so", ".pyc"]
CODE_SUFFIXES = [".py", ".ts", ".js", ".rs", ".go"]
MARKDOWN_SUFFIXES = [".md", ".txt", ".rst"]

# --- fixed values: synthetic prompts -----------------------------------------
TRIVIAL_TEMPLATES = [
    "What is {concept}?", "Explain {concept} briefly", "Define {concept}",
    "What does {acronym} stand for?", "Is {thing} a type of {category}?",
    "How many {unit} in a {thing}?", "When was {event}?", "Who created {thing}?",
    "List the top {n} {items}", "Convert {value} {from_unit} to {to_unit}",
    "What color is {thing}?", "Give me a synonym for {word}",
    "What is the opposite of {word}?", "Spell {word}", "What year did {event} happen?",
    "Tell me a fun fact about {thing}", "What is {number} plus {number2}?",
    "What is the capital of {place}?", "How do you say {word} in {language}?",
    "What is the abbreviation for {phrase}?", "Is {thing} bigger than {thing2}?",
    "What comes after {sequence}?", "Name a {category} that starts with {letter}",
    "What is {concept} in one sentence?", "Can you {simple_action}?",
    "What time is it?", "What day is today?", "What is the date?", "Say hello", "Hi there",
    "How are you?", "Good morning", "Thank you", "What is your name?", "Who are you?",
    "What can you do?",
]
LIGHT_TEMPLATES = [
    "Read the file at {path} and tell me what it does",
    "Summarize the following text: {short_text}", "Format this code: {code_snippet}",
    "What's wrong with this error: {error_message}", "Explain this function: {function_code}",
    "Add a docstring to: {function_signature}", "Rename variables in: {code_snippet}",
    "Write a test for: {function_signature}", "Check if {file} exists",
    "Count the lines in {file}", "Find all {pattern} in {file}",
    "Replace {old} with {new} in {file}", "Show me the last {n} lines of {file}",
    "What does this command do: {shell_cmd}", "Explain this regex: {regex}",
    "Make this code more readable: {code_snippet}", "Add type hints to: {function_code}",
    "Write a README for: {project_name}", "Create a .gitignore for: {language}",
    "What dependencies do I need for: {task}", "Fix the typo in: {code_snippet}",
    "Extract the email addresses from: {text}", "Parse this JSON: {json_snippet}",
    "Validate this YAML: {yaml_snippet}", "Sort this list: {list_data}",
    "Filter items where {condition}", "Group by {field} in: {data}",
    "Calculate the average of: {numbers}", "Find the maximum value in: {numbers}",
    "Deduplicate this list: {list_data}", "Reverse this string: {text}",
    "Split this text by {delimiter}: {text}", "Join these with {delimiter}: {list_data}",
    "Trim whitespace from: {text}", "Lowercase this: {text}", "Uppercase this: {text}",
    "Capitalize: {text}", "Title case: {text}",
]
_CONCEPTS = ["API", "REST", "GraphQL", "WebSocket", "HTTP", "DNS", "OAuth", "Docker",
             "Kubernetes", "Git", "JSON", "SQL", "Redis", "TypeScript", "Python", "Rust",
             "machine learning", "neural network", "microservices", "serverless",
             "hash table", "binary tree", "recursion", "closure", "async/await"]
_THINGS = ["byte", "kilobyte", "megabyte", "gigabyte", "terabyte", "pixel", "vector",
           "matrix", "tensor"]
_UNITS = ["bytes", "kilobytes", "megabytes", "seconds", "minutes", "hours", "meters",
          "kilometers"]
_FILES = ["src/main.py", "config/settings.json", "package.json", "README.md", ".env",
          "Makefile", "src/utils/helpers.ts", "tests/test_main.py", "requirements.txt"]
_SNIPPETS = ["def hello(): print('hello')", "const x = 1; const y = 2;",
             "for i in range(10): print(i)", "arr.map(x => x * 2)",
             "select * from users where id = 1", "import os; os.listdir('.')"]
_TEXTS = ["Python is a high-level programming language known for its readability and simplicity.",
          "Docker is a platform for developing, shipping, and running applications in containers.",
          "Git is a distributed version control system for tracking changes in source code."]
# slots without a pool here are left to the fallback word
TRIVIAL_POOLS = {
    "concept": _CONCEPTS,
    "acronym": ["API", "REST", "HTTP", "JSON", "URL", "HTML", "CSS", "CLI", "DNS", "SSH"],
    "thing": _THINGS, "thing2": _THINGS,
    "category": ["programming language", "framework", "database", "protocol",
                 "design pattern", "algorithm"],
    "unit": _UNITS, "from_unit": _UNITS, "to_unit": _UNITS,
    "event": ["the internet invented", "Python created", "Git released", "Docker launched",
              "the web invented"],
    "n": [str(i) for i in range(3, 11)],
    "items": ["programming languages", "databases", "frameworks", "sorting algorithms",
              "design patterns", "cloud providers"],
    "value": [str(i) for i in range(1, 101)],
    "word": ["happy", "fast", "beautiful", "complex", "simple", "run", "create", "build"],
    "number": [str(i) for i in range(1, 101)], "number2": [str(i) for i in range(1, 101)],
    "place": ["Brazil", "Japan", "Germany", "France", "Canada", "Australia", "India",
              "South Korea"],
    "language": ["Spanish", "French", "German", "Japanese", "Mandarin", "Portuguese",
                 "Italian", "Korean"],
    "phrase": ["Application Programming Interface", "HyperText Markup Language"],
    "sequence": ["Monday", "January", "2, 4, 6", "A, B, C"],
    "letter": list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "simple_action": ["help me", "explain", "summarize", "list", "find", "check", "show",
                      "tell me"],
}
LIGHT_POOLS = {
    "path": _FILES, "short_text": _TEXTS, "code_snippet": _SNIPPETS,
    "error_message": ["TypeError: undefined is not a function", "SyntaxError: unexpected token",
                      "KeyError: 'missing_key'", "TimeoutError: request timed out"],
    "function_code": _SNIPPETS,
    "function_signature": ["def calculate_total(items: list[float]) -> float",
                           "def parse_json(text: str) -> Optional[dict]",
                           "def validate_email(email: str) -> bool"],
    "file": _FILES, "pattern": [r"\d+", "[a-z]+", "#.*"],
    "old": ["foo", "bar", "temp", "x"], "new": ["bar", "baz", "result", "y"],
    "n": [str(i) for i in range(5, 21)],
    "shell_cmd": ["ls -la", "grep -r 'pattern' .", "df -h", "chmod +x script.sh"],
    "regex": ["^[a-z]+$", "(?i)error"],
    "project_name": ["my-app", "data-pipeline", "auth-service", "web-api"],
    "language": ["Python", "TypeScript", "Rust", "Go", "Java"],
    "task": ["web scraping", "data visualization", "API client", "CLI tool"],
    "text": _TEXTS, "delimiter": [",", ";", "|", " "],
    "list_data": ["[3, 1, 4, 1, 5, 9, 2, 6]"], "condition": ["x > 0"], "field": ["name"],
    "numbers": ["[10, 20, 30, 40, 50]"], "yaml_snippet": ["name: test\nversion: 1.0"],
}
GRADED_PROMPTS = {
    "trivial": ["Hi", "Hello", "What time is it?", "Thanks", "OK", "What is 2+2?",
                "Good morning", "Bye", "Yes", "No"],
    "light": ["Summarize this file in 3 sentences", "What is the capital of Brazil?",
              "Explain HTTP in simple terms", "List 5 benefits of caching",
              "What does CORS mean?", "How do I sort a list in Python?"],
    "moderate": ["Write a REST API endpoint for user authentication with JWT tokens",
                 "Compare microservices vs monolith architecture for a startup",
                 "Implement a rate limiter using Redis in Python",
                 "Design a database schema for an e-commerce platform"],
    "heavy": ["Design a distributed task queue with retry logic, dead letter queues, and "
              "monitoring. Include failure scenarios and recovery strategies.",
              "Implement a CI/CD pipeline for a microservices architecture with canary "
              "deployments, automated rollback, and performance gates."],
    "intensive": ["Design a real-time fraud detection system for a payment processor handling "
                  "10K TPS. Include feature engineering, model selection, latency requirements, "
                  "and false positive management."],
    "extreme": ["Design a global multi-region SaaS platform with zero-downtime deployments, "
                "automatic failover, data consistency across regions, and compliance with GDPR, "
                "HIPAA, and SOC2. Include cost analysis and migration strategy from existing "
                "monolith."],
}
GRADED_SUFFIX = " Please be detailed."
GRADED_PREFIX = "Given our existing system, "
