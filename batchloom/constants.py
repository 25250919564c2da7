"""Fixed values of the data formats this library reads and writes.

These are wire formats: keys of the JSON files, flags of the launched command
line, status names, file names and message texts. They must match the files
and tables that already exist, so they are stated here once and used by name
everywhere else.
"""

from __future__ import annotations

# --- fixed values: status domain -------------------------------------------
PENDING = "PENDING"
SCHEDULED = "SCHEDULED"
RUNNING = "RUNNING"
SUCCEEDED = "SUCCEEDED"
FAILED = "FAILED"
VERIFIED_OK = "VERIFIED_OK"
VERIFIED_FAILED = "VERIFIED_FAILED"
JOB_END_STATES = [SUCCEEDED, FAILED]

# --- fixed values: input types and the file endings each accepts ------------
CRAM = "cram"
FASTQ = "fastq"
FASTQ_LIST = "fastq-list"
EXTENSIONS = {CRAM: [".cram"], FASTQ: [".ora", ".gz"]}

# --- fixed values: file names, keys and flags -------------------------------
TRIGGER_FILE = "START_PIPELINE"
JOB_LIST_FILE = "jobs.csv"
DEFAULT_BATCH_CONFIG = "batch_config.json"
JOB_LABEL_KEY = "dragen-job"
TRIGGER_CONFIG_KEY = "config"
OPTIONS_KEY = "dragen_options"
LAUNCHER_KEY = "jarvice_options"
LAUNCHER_APP_KEY = "dragen_app"
LAUNCHER_MACHINE_KEY = "jarvice_machine_type"
MANIFEST_HEADER = "collaborator_sample_id\tcram_file_ref"
TASK_INDEX_PATTERN = r"group0-([0-9]+)"
SUCCESS_PATTERNS = [r"DRAGEN finished normally", r"DRAGEN complete\. Exiting"]
DATE_TOKEN = "<date>"
SAMPLE_TOKEN = "${SAMPLE_ID}"
OUTPUT_FLAG = "--output-directory"
SAMPLE_FLAG = "--vc-sample-name"
CRAM_FLAG = "--cram-input"
FASTQ_LIST_FLAG = "--fastq-list"
APP_FLAG = "--dragen-app"

# --- fixed values: variables of a task, in the order they are substituted ---
TASK_VARIABLES = ["SAMPLE_ID", "INPUT_PATH", "OUTPUT_PATH"]

# --- fixed values: defaults of optional settings -----------------------------
RUN_DEFAULTS = {
    "cpu_milli": 1000,
    "memory_mib": 512,
    "machine": "e2-micro",
    "parallelism": 3,
    "max_retry_count": 2,
    "max_run_duration": "7200s",
}
CHUNK_RUN_OPTIONS = {
    "max_run_duration": "7200s",
    "memory_mib": 512,
    "cpu_milli": 1000,
    "max_retry_count": 1,
}
DEFAULT_LAUNCHER_MACHINE = "nx1"
REPORT_AFTER = "2016-12-07 08:00:00"
REPORT_BEFORE = "2100-12-07 08:00:00"

# --- fixed values: notification texts ----------------------------------------
TASK_MESSAGE = (
    "_Task_ execution *{status}* for sample_id={sample_id} within {job_link}."
    "{log_link}{output_link}"
)
JOB_MESSAGE = "_Job_ execution *{status}* for {job_link}. {log_link}"
JOB_LINK = (
    "<https://console.cloud.google.com/batch/jobsDetail/regions/{region}/jobs/"
    "{job_name}/details?project={project}|{job_name}>"
)
OUTPUT_LINK = (
    " See the <https://console.cloud.google.com/storage/browser/{path}"
    "?project={project}|output directory> for the generated results."
)
LOG_LINK = (
    " Check the <https://console.cloud.google.com/logs/query;query=logName%3D%22"
    "projects%2F{project}%2Flogs%2Fbatch_task_logs%22%20OR%20%22projects%2F"
    "{project}%2Flogs%2Fbatch_agent_logs%22%20labels.job_uid%3D%22{job_uid}"
    "%22%20{task}timestamp%3E%3D%22{start}%22%20timestamp%3C%3D%22{end}%22"
    "?project={project}|logs> for more info."
)
LOG_LINK_TASK = "resource.labels.task_id%3D%22task%2F{task_id}%2F0%2F0%22"

# --- fixed values: time formats -----------------------------------------------
ROW_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
PATH_TIME_FORMAT = "yyyy-MM-dd-HH-mm-ss"
LINK_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"

# --- fixed values: the characters that count as white space --------------------
# WS is a character class that works in Java regular expressions and in RE2;
# WS_RUN is the same class in the form Java matches fastest, WS_CHARS is its text.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WS_RUN = r"(?U)[\s\x1c-\x1f]+"
WS_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
