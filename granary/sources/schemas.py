"""Schemas of the corpus formats; every field may be null, and a missing key reads as null."""

QUESTION = "question STRING, difficulty STRING, domain STRING, model_used STRING, generated_at STRING"
_META = "difficulty: STRING, domain: STRING, task_type: STRING, complexity: STRING, requires_reasoning: BOOLEAN, harm_category: STRING, token_count: BIGINT, teacher_model: STRING"
EASY = f"prompt STRING, response STRING, metadata STRUCT<{_META}>"
HARD = f"prompt STRING, draft STRING, thinking STRING, response STRING, metadata STRUCT<{_META}, reasoning_steps: BIGINT>"
CLEANED = EASY
DROP = "passage STRING, question STRING, answers ARRAY<STRING>"
GPQA = "question STRING, answer STRING, choices ARRAY<STRING>"
HUMANEVAL = "task_id STRING, prompt STRING, canonical_solution STRING, test STRING, entry_point STRING"
MATH = "problem STRING, solution STRING, level STRING, type STRING"
MGSM = "question STRING, answer STRING, answer_number STRING"
MMLU = "question STRING, choices ARRAY<STRING>, answer INT, subject STRING"
VALIDATION = "input STRING, output STRING, metadata STRUCT<difficulty: STRING, domain: STRING, source: STRING, task_type: STRING, benchmark: STRING>"
TEACHER = (
    "input STRING, output STRING, difficulty STRING, domain STRING, metadata STRUCT<original_output: STRING, example_id: BIGINT, teacher_model: STRING, "
    "generation_params: STRUCT<temperature: DOUBLE, do_sample: BOOLEAN, repetition_penalty: DOUBLE, max_tokens: INT>, num_tokens_generated: BIGINT, generation_time: DOUBLE>"
)
CHECKPOINT = "completed ARRAY<BIGINT>, completed_questions ARRAY<STRING>, failed ARRAY<STRUCT<question: STRING, difficulty: STRING, error: STRING>>, count BIGINT, timestamp STRING"
METRICS = "model_type STRING, avg_loss DOUBLE, perplexity DOUBLE, num_examples BIGINT, difficulty_metrics MAP<STRING, STRUCT<avg_loss: DOUBLE, perplexity: DOUBLE, count: BIGINT>>"
SPLIT_STATISTICS = (
    "total_examples BIGINT, train_examples BIGINT, test_examples BIGINT, test_percentage DOUBLE, train_difficulty_dist MAP<STRING, BIGINT>, "
    "test_difficulty_dist MAP<STRING, BIGINT>, train_domain_dist MAP<STRING, BIGINT>, test_domain_dist MAP<STRING, BIGINT>"
)
MANIFEST = "benchmarks ARRAY<STRUCT<name: STRING, count: BIGINT, file: STRING, error: STRING>>, total_questions BIGINT, output_dir STRING"
