"""Values that must be exactly these for results to agree with existing run logs.

Everything here is fixed: prompt wording, marker lists, prefixes, log tags, metric names and
units. No logic lives in this module.
"""

# --- Fixed values: prompt templates --------------------------------------------------------
SYSTEM_MESSAGE = (
    "You are an expert Python developer specializing in writing correct, efficient, "
    "and test-passing code."
)

PROMPT_HEAD = """You are an expert Python developer.

Complete the following function so that it passes all test cases.

"""

PROMPT_TAIL = """

# Write your solution below:

Write ONLY the function body code (the indented code that goes inside the function). 
Requirements:
- Start each line with 4 spaces for the function body
- Use 8 spaces for nested blocks (inside if/for/while)
- Use 12 spaces for nested blocks inside nested blocks
- Do NOT include the function signature, imports, or docstring
- Write complete, executable code that solves the problem"""

CORRECTION_TAIL = """

# Write your solution below:

The previous attempt had issues. Please write a corrected solution.
Requirements:
- Start each line with 4 spaces for the function body
- Use 8 spaces for nested blocks (inside if/for/while)
- Do NOT include the function signature, imports, or docstring
- Write complete, executable code that solves the problem
- Handle edge cases carefully
"""

REASONING_HEAD = "Let's reason step by step to solve: "
TASK_ID_PREFIX = "HumanEval/"
REFLECTION_SEPARATOR = "::reflection-"

# --- Fixed values: completion clean-up ----------------------------------------------------
STUB_BODY = "    pass"
MIN_COMPLETION_CHARS = 10
MIN_SANITIZED_CHARS = 5
ERROR_MARKERS = [
    "CUDA error",
    "device-side assert triggered",
    "gpu_mem_get_info_error",
    "Traceback (most recent call last)",
    "[ERROR]",
    "Assertion `probability tensor contains",
]
PREFACES = ["Here is", "Here's", "The function", "The implementation", "Implementation"]
DROPPED_LINE_PREFIXES = ["from ", "import ", "def ", "class "]
EXPLANATION_WORDS = ["This", "The", "It", "Here", "Note", "Explanation"]
CODE_MARKERS = ["def ", "return"]
INVALID_RESULT = "syntax_error"

# --- Fixed values: evaluation -----------------------------------------------------------
PASS_KS = [1, 10, 100]
MIN_SECONDS = 0.001
PERCENTILE_95 = 0.95
SWEEP_AGENT_COUNTS = [500, 1000, 1500, 2000]

# --- Fixed values: memory snapshot stages -----------------------------------------------
STAGES = [
    ("model_load", "before_model_load_gpu", "after_model_load_gpu", "delta_model_load"),
    ("inference", "before_inference_gpu", "after_inference_gpu", "delta_inference"),
]

# --- Fixed values: skipped lines of profiler text ---------------------------------------
PERF_SKIPPED_PREFIXES = ["#", "Performance counter", "Error", "Failed"]
STRACE_SKIPPED_PREFIXES = ["% time", "------"]
PIDSTAT_SKIPPED_TEXTS = ["PID", "Linux"]

# --- Fixed values: comparison table (metric, column, unit, higher is better, always shown) --
COMPARED_METRICS = [
    ("avg_latency_s", "avg_latency_s", " s", False, True),
    ("throughput_rps", "throughput_rps", " req/s", True, True),
    ("context_switches", "context_switches_per_sec", " /s", False, True),
    ("cpu_util", "cpu_util", " %", True, True),
    ("gpu_idle_time", "gpu_idle", " %", False, True),
    ("sched_latency", "avg_sched_latency_us", " μs", False, False),
    ("successes", "successes", "", True, True),
]
REPORT_TITLE = "KERNEL OPTIMIZATION BENCHMARK RESULTS"
REPORT_CHANGE_HEADING = "Δ Improvement"
REPORT_WIDTH = 80
REPORT_COLUMN_WIDTHS = (25, 20, 20, 15)

# --- Fixed values: bands and gates ------------------------------------------------------
WARM_CELSIUS = 70.0
HOT_CELSIUS = 80.0
CAPACITY_THRESHOLD = 0.9
PROGRESS_EVERY = 10
REPORT_EVERY = 6
MAIN_COMMAND = "main.py"

# --- Fixed values: tall metric names (name, column) ---------------------------------------
SNAPSHOT_METRICS = [
    ("GPU_Memory/VRAM_Used_GB", "gpu_vram_used_gb"),
    ("GPU_Memory/VRAM_Free_GB", "gpu_vram_free_gb"),
    ("GPU_Memory/VRAM_Total_GB", "gpu_vram_total_gb"),
    ("GPU_Memory/PyTorch_Allocated_GB", "gpu_mem_allocated_gb"),
    ("GPU_Memory/PyTorch_Reserved_GB", "gpu_mem_reserved_gb"),
    ("CPU_Memory/RAM_Used_GB", "cpu_ram_used_gb"),
    ("CPU_Memory/RAM_Total_GB", "cpu_ram_total_gb"),
    ("CPU_Memory/RAM_Percent", "cpu_ram_percent"),
]
RESOURCE_METRICS = [
    ("Resource/CPU_Utilization_%", "cpu_percent"),
    ("Resource/RAM_Usage_%", "ram_percent"),
    ("Resource/RAM_Used_GB", "ram_used_gb"),
]
