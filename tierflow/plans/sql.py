"""SQL fragments for the check queries. They restate each operator in plain SQL;
only the fixed word lists and numbers are shared with the Spark side."""

from __future__ import annotations

from tierflow import vocab as V
from tierflow.sources.adapters import PHRASES

WORD = r"[\p{L}\p{N}_]"
SPACE = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ",".join(s(i) if isinstance(i, str) else repr(i) for i in items) + "]"


def has(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col},{s(n)})" for n in needles) + ")"


def n_has(col: str, needles) -> str:
    return "(" + "+".join(f"contains({col},{s(n)})::INT" for n in needles) + ")"


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col},{s(pattern)})"


def rx_n(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col},{s(pattern)}))"


def alt(words) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.").replace("+", r"\+") for w in words) + ")"


def strip(col: str) -> str:
    return f"regexp_replace({col},{s(f'^[{SPACE}]+|[{SPACE}]+$')},'','g')"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def sentences(col: str) -> str:
    return rx_n(col, rf"[^.!?{SPACE}][^.!?]*")


def ws_words(col: str) -> str:
    return rx_n(col, f"[^{SPACE}]+")


def ws_list(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col},{s(f'[{SPACE}]+')}), lambda w: w <> '')"


def n_in(words: str, vocabulary) -> str:
    return f"len(list_filter({words}, lambda w: list_contains({lst(vocabulary)}, w)))"


def clamp(e: str, lo="0.0", hi="1.0") -> str:
    return f"least(greatest({e},CAST({lo} AS DOUBLE)),CAST({hi} AS DOUBLE))"


def case_map(col: str, pairs, default) -> str:
    body = " ".join(f"WHEN {s(k) if isinstance(k, str) else k} THEN {s(v) if isinstance(v, str) else repr(v) + '::DOUBLE'}"
                    for k, v in pairs)
    d = s(default) if isinstance(default, str) else ("NULL" if default is None else f"{default!r}::DOUBLE")
    return f"(CASE {col} {body} ELSE {d} END)"


def tier_of(score: str, bounds) -> str:
    body = " ".join(f"WHEN {score} < {b!r}::DOUBLE THEN '{t}'" for b, t in zip(bounds, V.TIERS))
    return f"(CASE {body} ELSE 'extreme' END)"


def tier_at(idx: str) -> str:
    return f"({lst(V.TIERS)})[CAST({idx} AS INT) + 1]"


def tier_idx(tier: str) -> str:
    return f"(list_position({lst(V.TIERS)},{tier}) - 1)"


def midpoint(tier: str, default=0.25) -> str:
    return case_map(tier, V.TIER_MIDPOINTS.items(), default)


def uhash(value: str, seed) -> str:
    return f"('0x'||substr(md5(CAST({value} AS VARCHAR)||':{seed}'),1,8))::BIGINT"


def phrase(key: str) -> str:
    return f"({lst(PHRASES)})[CAST(({key}) % {len(PHRASES)} AS INT) + 1]"


PROMPTS = f"""prompts AS (
  SELECT doc_id AS id, {phrase('doc_id')}||' '||text AS text FROM documents
  UNION ALL
  SELECT 1000000000000+conv_id*100+turn, {phrase('conv_id+turn')}||' '||text
  FROM conversations WHERE role='user')"""

INTERACTIONS = f"""i0 AS (
  SELECT event_id AS interaction_id, ts, concat('agent-', user_id % 10) AS agent_id,
    (event_id*7+user_id) % 6 AS predicted_idx,
    CASE WHEN event_id % 5 = 0 THEN NULL
         WHEN event_id % 3 = 0 THEN least(5, (event_id*7+user_id) % 6 + 1)
         WHEN event_id % 7 = 0 THEN greatest(0, (event_id*7+user_id) % 6 - 1)
         ELSE (event_id*7+user_id) % 6 END AS actual_idx,
    CASE WHEN event_type='error' THEN 0 ELSE CAST(floor(value*20) AS BIGINT) END AS tokens_in,
    CASE WHEN event_type='error' THEN 0 ELSE CAST(floor(value*5) AS BIGINT) END AS tokens_out,
    CAST(floor(value*100) AS BIGINT) AS latency_ms,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 11 AS DOUBLE)/10 END AS adequacy,
    CASE WHEN event_type='error' THEN 'error' ELSE 'success' END AS status,
    CASE event_id % 6 WHEN 0 THEN 'openrouter/owl-alpha' WHEN 1 THEN 'openrouter/z-ai/glm-4.7-flash'
      WHEN 2 THEN 'qwen/qwen-plus' WHEN 3 THEN 'anthropic/claude-sonnet-4.6'
      WHEN 4 THEN 'anthropic/claude-opus-4.6' ELSE 'bailian/qwen3.5-plus' END AS routed_model
  FROM events),
interactions AS (SELECT *, {tier_at('predicted_idx')} AS predicted_tier,
  CASE WHEN actual_idx IS NULL THEN NULL ELSE {tier_at('actual_idx')} END AS actual_tier FROM i0)"""

MESSAGES = """messages AS (
  SELECT CAST(floor(conv_id/20) AS BIGINT) AS session_id, conv_id*100+turn AS pos,
    CASE WHEN role='user' AND turn % 4 = 2 AND conv_id % 3 = 0 THEN 'tool' ELSE role END AS role,
    CASE conv_id % 5 WHEN 0 THEN 'The final decision: use kafka. '
      WHEN 1 THEN 'error: timeout in the docker deployment. '
      WHEN 2 THEN 'async function and database schema must change. ' ELSE '' END || repeat(text, 5) AS text,
    CASE WHEN role='assistant' AND turn % 4 = 1 AND conv_id % 3 = 0
      THEN ['tc_'||conv_id||'_'||turn] END AS calls,
    CASE WHEN role='user' AND turn % 4 = 2 AND conv_id % 3 = 0
      THEN 'tc_'||conv_id||'_'||(turn-1) END AS tool_call_id
  FROM conversations)"""

RESPONSES = f"""responses AS (
  SELECT u.conv_id*100+u.turn AS id, u.text AS prompt,
    repeat(a.text||' ', CAST(1+(u.conv_id*7)%40 AS INT)) AS response,
    {tier_at('(u.conv_id+u.turn) % 6')} AS predicted_tier,
    (u.conv_id*37+u.turn*11) % 3000 AS tokens_out,
    (u.conv_id*977+u.turn*131) % 40000 AS latency_ms
  FROM conversations u JOIN conversations a ON a.conv_id=u.conv_id AND a.turn=u.turn+1
  WHERE u.role='user' AND a.role='assistant')"""

VOTES = f"""{INTERACTIONS},
requests AS (SELECT interaction_id AS request_id, agent_id, ts AS asked_at, predicted_tier FROM interactions),
replies AS (SELECT interaction_id AS reply_id, agent_id, ts + to_seconds(interaction_id % 600 + 1) AS replied_at,
  (['yes','✅','no','wrong heavy','correct light','maybe later'])[CAST(interaction_id % 6 AS INT)+1] AS reply_text
  FROM interactions)"""

ATTEMPTS = f"""{INTERACTIONS},
attempts AS (SELECT interaction_id, predicted_tier, pos,
  (['200','429','500','400','timeout'])[CAST((interaction_id*3+pos*2) % 5 AS INT)+1] AS status
  FROM interactions, (SELECT unnest(range(0,5)) AS pos))"""


def kw(col: str, distinct=True, stops=V.STOP_PREFIXES) -> str:
    base = (f"list_filter(regexp_split_to_array(lower({col}),{s(f'[{SPACE}]+')}), "
            f"lambda w: length(w) > 4 AND NOT regexp_matches(w,{s('^' + alt(stops))}))")
    if distinct:  # keeps first occurrences in order
        base = (f"(SELECT list(w ORDER BY p) FROM (SELECT w, min(p) AS p FROM "
                f"(SELECT unnest(l) AS w, generate_subscripts(l,1) AS p FROM (SELECT {base} AS l)) GROUP BY w))")
        return f"coalesce(list_slice({base},1,10),[])"
    return f"list_slice({base},1,10)"


def tags(col: str) -> str:
    items = ",".join(f"CASE WHEN {has(f'lower({col})', w)} THEN '{n}' END" for n, w in V.TOPIC_GROUPS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


INDEX = f"""idx AS (SELECT conv_id*100+turn AS entry_id, conv_id*100+turn AS created,
    {kw('text', distinct=True)} AS keywords, {tags('text')} AS tags,
    {tier_at('(conv_id+turn*5) % 6')} AS tier, role AS original_role,
    ((conv_id+turn) % 11)/10.0::DOUBLE AS adequacy, substr(text,1,200) AS summary,
    CAST(length(text) AS BIGINT) AS original_tokens, CAST(floor(length(text)/3) AS BIGINT) AS compressed_tokens
  FROM conversations WHERE role='assistant')"""


def rnd(e: str, n: int = 6) -> str:
    return f"round(CAST({e} AS DOUBLE),{n})"


def even(e: str, n: int) -> str:
    """Python's ``round``, as ``functions.num.even`` does it."""
    v, s = f"CAST({e} AS DOUBLE)", f"{10 ** n}::DOUBLE"
    p, c = f"({v}*{s})", f"({v}*134217729::DOUBLE)"
    h = f"({c}-({c}-{v}))"
    lost, tie = f"(({h}*{s}-{p})+({v}-{h})*{s})", f"{p}-floor({p})=0.5"
    return f"(CASE WHEN {tie} AND {lost}>0 THEN floor({p})+1 WHEN {tie} AND {lost}<0 THEN floor({p}) ELSE round_even({p},0) END/{s})"


STEPS = r"first|then|next|finally|step\s*[0-9]"
NEEDS = r"the file|this project|my code|our system|given that|consider"


def f1(src="prompts", rounded=True, name="f1") -> str:
    r = (lambda e: even(e, 3)) if rounded else (lambda e: e)
    code = rf"```|`[^`]+`|def\s+{WORD}|const\s+{WORD}|function\s+{WORD}|import\s+"
    return f"""{name}_t AS (SELECT *, lower(text) AS low, regexp_extract_all(lower(text),'{WORD}+') AS words FROM {src}),
{name}_c AS (SELECT *, len(words) AS wc, length(array_to_string(words,'')) AS chars,
   {n_in('words', V.TECH_WORDS)} AS tech, {n_in('words', V.VAGUE_WORDS)} AS vague,
   {rx('text', code)} AS code, contains(text,'?') AS q, {rx('low', '^' + alt(V.IMPERATIVES))} AS imp FROM {name}_t),
{name} AS (SELECT * EXCLUDE (low, words, wc, chars, tech, vague, code, q, imp), wc::DOUBLE AS word_count,
   {sentences('text')}::DOUBLE AS sentence_count, {r('chars/greatest(wc,1)::DOUBLE')} AS avg_word_length,
   code::INT::DOUBLE AS has_code, q::INT::DOUBLE AS has_question, imp::INT::DOUBLE AS has_imperative,
   tech::DOUBLE AS technical_terms, (q AND tech>0)::INT::DOUBLE AS question_technical,
   {has('low', V.ARCH_PHRASES)}::INT::DOUBLE AS architecture,
   {has('low', V.DESIGN_PHRASES)}::INT::DOUBLE AS technical_design,
   {rx('low', STEPS)}::INT::DOUBLE AS multi_step, {rx('low', NEEDS)}::INT::DOUBLE AS requires_context,
   {r('tech/greatest(wc,1)::DOUBLE')} AS domain_specificity, {r('vague/greatest(wc,1)::DOUBLE')} AS ambiguity_score,
   (code::INT+q::INT+imp::INT+(tech>=3)::INT >= 4)::INT::DOUBLE AS four_plus FROM {name}_c)"""


def f2(src="prompts", name="f2") -> str:
    code = rf"```|`[^`]+`|def\s+{WORD}|const\s+{WORD}|function\s+{WORD}|class\s+{WORD}|import\s+[\p{{L}}\p{{N}}_.]"
    b, e = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    steps = rf"first|then|next|after that|finally|step\s*[0-9]|{b}and also{e}|{b}plus{e}"
    sel = rf"{b}select{e}[^\n]*{b}from{e}|{b}select[^\p{{L}}\p{{N}}_\n]from{e}"
    return f"""{name}_t AS (SELECT *, lower(text) AS low, regexp_extract_all(lower(text),'{WORD}+') AS words FROM {src}),
{name}_c AS (SELECT *, len(words) AS wc, length(array_to_string(words,'')) AS chars,
   {n_in('words', V.SAMPLE_TECH_WORDS)} AS tech, {n_in('words', V.SAMPLE_VAGUE_WORDS)} AS vague FROM {name}_t),
{name} AS (SELECT * EXCLUDE (low, words, wc, chars, tech, vague), wc::DOUBLE AS word_count,
   {sentences('text')}::DOUBLE AS sentence_count, {even('chars/greatest(wc,1)::DOUBLE', 2)} AS avg_word_length,
   {rx('text', code)} AS has_code, contains(text,'?') AS has_question,
   {rx('low', '^' + alt(V.SAMPLE_IMPERATIVES))} AS has_imperative, tech::DOUBLE AS technical_terms,
   (contains(text,'?') AND tech>0) AS question_technical,
   {has('low', V.SAMPLE_ARCH_PHRASES)} AS architecture, {has('low', V.SAMPLE_DESIGN_PHRASES)} AS technical_design,
   {rx('low', steps)} AS multi_step,
   {rx('low', 'the file|this project|my code|our system|the config|the database')} AS requires_context,
   CASE WHEN {rx('low', rf'{b}def\s+{WORD}')} OR contains(low,'python') THEN 'python'
        WHEN {rx('low', rf'{b}(?:const|let|var)\s+{WORD}')} OR contains(low,'typescript') THEN 'typescript'
        WHEN {rx('low', rf'{b}fn\s+{WORD}')} OR contains(low,'rust') THEN 'rust'
        WHEN {rx('low', rf'{b}func\s+{WORD}')} OR contains(low,'golang') THEN 'go'
        WHEN {rx('low', sel)} THEN 'sql' ELSE 'unknown' END AS code_language,
   {even('tech/greatest(wc,1)::DOUBLE', 3)} AS domain_specificity,
   {even('vague/greatest(wc,1)::DOUBLE', 3)} AS ambiguity_score FROM {name}_c)"""


def f3(src="prompts", name="f3") -> str:
    code = rf"```|`[^`]+`|def\s+{WORD}|const\s+{WORD}|function\s+{WORD}"
    return f"""{name}_t AS (SELECT *, lower(text) AS low, regexp_extract_all(lower(text),'{WORD}+') AS words FROM {src}),
{name}_c AS (SELECT *, len(words) AS wc, length(array_to_string(words,'')) AS chars,
   {n_in('words', V.FEEDBACK_TECH_WORDS)} AS tech FROM {name}_t),
{name} AS (SELECT * EXCLUDE (low, words, wc, chars, tech), wc::DOUBLE AS word_count,
   {sentences('text')}::DOUBLE AS sentence_count, {even('chars/greatest(wc,1)::DOUBLE', 2)} AS avg_word_length,
   {rx('text', code)} AS has_code, contains(text,'?') AS has_question,
   {rx('low', '^' + alt(V.FEEDBACK_IMPERATIVES))} AS has_imperative, tech::DOUBLE AS technical_terms,
   (contains(text,'?') AND tech>0) AS question_technical,
   {has('low', V.FEEDBACK_ARCH_PHRASES)} AS architecture, {has('low', V.FEEDBACK_DESIGN_PHRASES)} AS technical_design,
   {rx('low', STEPS + '|after that')} AS multi_step,
   {rx('low', 'the file|this project|my code|our system')} AS requires_context,
   {even('tech/greatest(wc,1)::DOUBLE', 3)} AS domain_specificity, 0.1::DOUBLE AS ambiguity_score FROM {name}_c)"""


def f4(src, name="f4") -> str:
    langs = " ".join(f"WHEN {has('low', m)} THEN '{n}'" for n, m in V.GENERATOR_LANGUAGE_MARKERS)
    return f"""{name}_t AS (SELECT *, lower(text) AS low, regexp_extract_all(lower(text),'{WORD}+') AS words FROM {src}),
{name}_c AS (SELECT *, len(words) AS wc, length(array_to_string(words,'')) AS chars,
   {n_in('words', V.GENERATOR_TECH_WORDS)} AS tech, list_has_any(words,{lst(V.GENERATOR_INTERROGATIVES)}) AS ask FROM {name}_t),
{name} AS (SELECT * EXCLUDE (low, words, wc, chars, tech, ask), wc::DOUBLE AS word_count,
   {sentences('text')}::DOUBLE AS sentence_count, {even('chars/greatest(wc,1)::DOUBLE', 2)} AS avg_word_length,
   {has('text', V.GENERATOR_CODE_MARKERS)} AS has_code, (contains(text,'?') OR ask) AS has_question,
   {rx('low', '^' + alt(V.GENERATOR_IMPERATIVES))} AS has_imperative, tech::DOUBLE AS technical_terms,
   (ask AND tech>0) AS question_technical, CASE {langs} ELSE 'unknown' END AS code_language,
   {even('tech/greatest(wc,1)::DOUBLE', 3)} AS domain_specificity,
   CASE WHEN label='trivial' THEN 0.1 ELSE 0.2 END::DOUBLE AS ambiguity_score FROM {name}_c)"""


def signals() -> dict[str, str]:
    return {
        "has_question": "contains(text,'?')", "has_code": has("low", V.SIGNAL_CODE),
        "has_imperative": rx("low", "^" + alt(V.SIGNAL_IMPERATIVES) + " "),
        "has_arithmetic": rx("text", r"[0-9]+\s*[+\-*/=]"),
        "has_sequential": has("low", V.SIGNAL_SEQUENCE), "has_constraint": has("low", V.SIGNAL_CONSTRAINT),
        "has_context": has("low", V.SIGNAL_CONTEXT), "has_architecture": has("low", V.SIGNAL_ARCHITECTURE),
        "has_design": has("low", V.SIGNAL_DESIGN)}


def f5(src="prompts", name="f5") -> str:
    sig = signals()
    sigcols = ",".join(f"{e}::INT::DOUBLE AS {n}" for n, e in sig.items())
    doms = ",".join(f"{has('low', w)}::INT::DOUBLE AS domain_{n}" for n, w in V.DOMAIN_WORDS.items())
    dsum = "+".join(f"domain_{n}" for n in V.DOMAIN_WORDS)
    expert = (f"len(list_filter(words, lambda w: (length(w) > 10 AND list_contains({lst(V.TECH_WORDS)}, w)) "
              f"OR regexp_matches(w,{s('^' + alt(V.EXPERT_WORDS) + chr(92) + 'b')})))")
    b = r"\b"
    return f"""{name}_t AS (SELECT *, lower(text) AS low, {ws_list('lower(text)')} AS words,
   array_to_string(regexp_extract_all(text,'(?s)```.*?```'),'') AS blocks, {rx_n('text', '(?s)```.*?```')} AS n_blocks FROM {src}),
{name}_c AS (SELECT *, len(words) AS wc, {n_in('words', V.TECH_WORDS)} AS tech, {expert} AS expert, {sigcols}, {doms} FROM {name}_t),
{name} AS (SELECT * EXCLUDE (low, words, blocks, n_blocks, wc, tech, expert), wc::DOUBLE AS ws_words,
   {sentences('text')}::DOUBLE AS sentence_count, length(array_to_string(words,''))/greatest(wc,1)::DOUBLE AS avg_word_length,
   (contains(text,'?') AND tech>0)::INT::DOUBLE AS question_technical,
   greatest(has_design, has_architecture) AS technical_design, tech::DOUBLE AS technical_terms,
   {rx('low', STEPS)}::INT::DOUBLE AS multi_step, {rx('low', b + alt(V.NEGATION_WORDS) + b)}::INT::DOUBLE AS has_negation,
   ({rx_n('text', V.ENTITY_COMPANY)}+{rx_n('text', b + '[A-Z]{2,}' + b)}+{rx_n('text', V.ENTITY_MONEY)}+{rx_n('text', V.ENTITY_DATE)})::DOUBLE AS entity_count,
   (n_blocks + length(blocks) - length(replace(blocks,chr(10),'')))::DOUBLE AS code_block_size,
   {rx_n('text', f'(?i){b}(?:{V.TEMPORAL}){b}')}::DOUBLE AS temporal_references,
   {rx('low', f'{b}(?:{V.OUTPUT_FORMAT}){b}')}::INT::DOUBLE AS output_format_spec,
   {rx('low', f'{b}(?:{V.PRIOR_CONTEXT}){b}')}::INT::DOUBLE AS prior_context_needed,
   len(list_distinct(words))/greatest(wc,1)::DOUBLE AS novelty_score,
   ({dsum} >= 2)::INT::DOUBLE AS multi_domain,
   CASE WHEN expert>=3 THEN 2 WHEN expert>=1 THEN 1 ELSE 0 END::DOUBLE AS user_expertise_level FROM {name}_c)"""


def f6(src="prompts", variant="voter", name="f6") -> str:
    if variant == "voter":
        words = ws_list("lower(text)")
        code = rx("text", "def |function |class |import |const |let |var ")
        arch = rx("text", "architecture|system design|microservice|distributed")
        design = rx("text", "implementation|deployment|pipeline|schema")
        imp = rx(strip("low"), "^(?:write|create|build|implement|generate|fix|debug|analyze)")
        tech = ["api", "http", "rest", "docker", "kubernetes", "database", "algorithm", "security",
                "async", "await", "error", "type"]
        dom = rx("low", "finance|legal|medical|engineering|compliance|gdpr|hipaa|wacc|ebitda")
        amb = rx(strip("low"), "^(?:help|what|how|why|do|can|is|are)")
    else:
        words = f"regexp_extract_all(lower(text),'{WORD}+')"
        code = rx("text", rf"```|`[^`]+`|def\s+{WORD}|const\s+{WORD}|function\s+{WORD}|import\s+")
        arch, design = has("low", V.ARCH_PHRASES), has("low", V.DESIGN_PHRASES)
        imp, tech = rx("low", "^" + alt(V.IMPERATIVES)), V.TECH_WORDS
        dom = rx("low", "finance|legal|medical|engineering|compliance|gdpr|hipaa|wacc")
        amb = rx(strip("low"), r"^(?:help|what|how|why|do|can|is|are)(?:$|[^\p{L}\p{N}_])")
    return f"""{name}_t AS (SELECT *, lower(text) AS low, {words} AS words FROM {src}),
{name}_c AS (SELECT *, len(words) AS wc, {n_in('words', tech)} AS tech, {sentences('text')} AS sc FROM {name}_t),
{name} AS (SELECT * EXCLUDE (low, words, wc, tech, sc), sc/10.0::DOUBLE AS sentence_count,
   length(array_to_string(words,''))/greatest(wc,1)::DOUBLE/10.0::DOUBLE AS avg_word_length,
   contains(text,'?')::INT::DOUBLE AS has_question, (contains(text,'?') AND tech>0)::INT::DOUBLE AS question_technical,
   {design}::INT::DOUBLE AS technical_design, {code}::INT::DOUBLE AS code, {arch}::INT::DOUBLE AS architecture,
   wc/100.0::DOUBLE AS word_count, (sc>4)::INT::DOUBLE AS four_plus, {imp}::INT::DOUBLE AS has_imperative,
   tech/5.0::DOUBLE AS technical_terms, {rx('low', STEPS)}::INT::DOUBLE AS multi_step,
   {rx('low', NEEDS)}::INT::DOUBLE AS requires_context, {dom}::INT::DOUBLE AS domain_specificity,
   {amb}::INT::DOUBLE AS ambiguity_score FROM {name}_c)"""


def f8(src="prompts", name="f8") -> str:
    n = "+".join(f"{e}::INT" for e in signals().values())
    return f"""{name}_t AS (SELECT *, lower(text) AS low, {ws_words('text')} AS wc FROM {src}),
{name} AS (SELECT * EXCLUDE (low, wc), wc::BIGINT AS ws_words, (CASE WHEN wc>0 THEN {n} ELSE 0 END)::BIGINT AS signals,
   (wc>0 AND {signals()['has_context']}) AS has_context,
   (CASE WHEN wc>0 THEN {n_has('low', V.SYSTEM_WORDS)} ELSE 0 END)::BIGINT AS system_words FROM {name}_t)"""


def heuristic(w=V.DEFAULT_WEIGHTS) -> str:
    g = lambda n: f"{float(w.get(n, 0.0))!r}::DOUBLE"
    terms = [f"{g('sentence_count')}*(least(sentence_count,10)/10.0::DOUBLE)",
             f"{g('avg_word_length')}*(avg_word_length/10.0::DOUBLE)", f"{g('has_question')}*has_question",
             f"{g('question_technical')}*question_technical", f"{g('technical_design')}*technical_design",
             f"{g('code')}*has_code", f"{g('architecture')}*architecture",
             f"{g('word_count')}*(ln(1+word_count)/6.0::DOUBLE)", f"{g('four_plus')}*four_plus",
             f"{g('has_imperative')}*has_imperative",
             f"{g('technical_terms')}*(least(technical_terms,10)/10.0::DOUBLE)",
             f"{g('multi_step')}*multi_step", f"{g('requires_context')}*requires_context",
             f"{g('domain_specificity')}*domain_specificity", f"{g('ambiguity_score')}*ambiguity_score"]
    return clamp("(" + "+".join(terms) + ")*(CASE WHEN word_count<10 AND architecture=0 THEN 0.7 ELSE 1.0 END)::DOUBLE")


def bonus(words: str, count: str) -> str:
    return (f"(CASE WHEN {words}>=15 AND {count}>=5 THEN 0.35 WHEN {words}>=15 AND {count}>=4 THEN 0.25 "
            f"WHEN {words}>=12 AND {count}>=3 THEN 0.15 WHEN {words}>=10 AND {count}>=3 THEN 0.10 "
            f"WHEN {words}>=10 AND {count}>=2 THEN 0.05 WHEN {count}>=2 THEN 0.03 ELSE 0 END)::DOUBLE")


RAW_SIGNAL = (f"(signals*0.15::DOUBLE + ln(1+ws_words::DOUBLE)*0.08::DOUBLE + "
              f"(CASE WHEN has_context THEN 0.1 ELSE 0 END)::DOUBLE + {bonus('ws_words', 'system_words')})")
GATEWAY_SIGNALS = "(" + "+".join(["has_question", "has_code", "has_imperative", "has_arithmetic", "has_sequential",
                                   "has_constraint", "has_context", "has_architecture", "has_design"]) + ")"
GATEWAY_SYS = "(has_architecture+technical_design+(technical_terms>3)::INT+multi_domain)"
GATEWAY_HEURISTIC = clamp(f"{GATEWAY_SIGNALS}*0.15::DOUBLE + ln(1+ws_words)*0.08::DOUBLE + has_context*0.1::DOUBLE + "
                          f"{bonus('ws_words', GATEWAY_SYS)}")


def logit(tier: str, weights=V.CASCADE_WEIGHTS, code_zero=True) -> str:
    b, ws = weights[tier]
    t = [f"{n if n != 'code' else ('0' if code_zero else 'has_code')}*({w!r}::DOUBLE)"
         for n, w in zip(V.FEATURE_NAMES, ws)]
    return "(" + "+".join(t) + f"+({b!r}::DOUBLE))"


def cascade(src="f1", name="casc") -> str:
    logits = ",".join(f"{logit(t)} AS l{i}" for i, t in enumerate(V.CASCADE_TIERS))
    pick = " ".join(f"WHEN l{i}-l{i+1} > 0 THEN {V.TIER_MIDPOINTS[V.TIERS[i]]}" for i in range(4))
    conf = " ".join(f"WHEN l{i}-l{i+1} > 0 THEN least(1.0/(1.0+exp(-(l{i}-l{i+1}))),0.99::DOUBLE)" for i in range(4))
    return f"""{name}_l AS (SELECT *, {heuristic()} AS h, {logits} FROM {src}),
{name}_s AS (SELECT *, {even(clamp(f'0.6::DOUBLE*h+0.4::DOUBLE*(CASE {pick} ELSE 0.86 END)::DOUBLE'), 4)} AS score,
   {even(f'CASE {conf} ELSE 0.5 END', 4)} AS confidence FROM {name}_l),
{name} AS (SELECT *, {tier_of('score', V.CLASSIC_BOUNDS)} AS tier FROM {name}_s)"""


def values(name: str, cols: str, rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        if isinstance(v, int):
            return f"{v}::BIGINT"
        return s(v)
    return f"{name}({cols}) AS (VALUES " + ",".join("(" + ",".join(lit(v) for v in r) + ")" for r in rows) + ")"
