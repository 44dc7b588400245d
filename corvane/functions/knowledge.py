"""What the analyses know of C libraries."""

from __future__ import annotations

# API names that decide what is reported, kept, and how it ranks.

SAFE_FUNCTIONS = frozenset("""
memcpy_s strcpy_s sprintf_s strcat_s snprintf strncpy strlcpy strlcat
execve execv execvp execl execlp execle
sqlite3_prepare_v2 sqlite3_bind_text sqlite3_bind_int sqlite3_bind_blob mkstemp openat
""".split())
SAFE_WRAPPERS = frozenset("""
SafeCopy_copy SafeCopy_strcpy SafeQuery_prepare SafeQuery_bind_text SafeQuery_exec
ResourceHandle_create ResourceHandle_destroy LockGuard_create LockGuard_release
""".split())
BUFFER_OVERFLOW_APIS = frozenset("memcpy strcpy strcat strncpy strncat memmove gets scanf sscanf fscanf fread read recv".split())
INJECTION_APIS = frozenset("""
sprintf snprintf system popen execl execlp execle execv execvp execve
sqlite3_exec sqlite3_prepare mysql_query mysql_real_query PQexec PQexecParams
CreateProcessA CreateProcessW CreateProcessAsA CreateProcessAsW
ShellExecuteA ShellExecuteW ShellExecuteEx ShellExecuteExA ShellExecuteExW
""".split())
COMMAND_SINKS = frozenset("""
system popen CreateProcessA CreateProcessW CreateProcessAsA CreateProcessAsW
ShellExecuteA ShellExecuteW ShellExecuteEx ShellExecuteExA ShellExecuteExW
execl execlp execle execv execvp execve
""".split())
CRITICAL_APIS = COMMAND_SINKS
HIGH_APIS = frozenset("strcpy strcat sprintf gets memcpy".split())
MEDIUM_APIS = frozenset("strncpy strncat snprintf fread scanf sscanf fscanf".split())
BOUNDED_COPIES = frozenset("strncpy strncat memcpy memmove".split())
#: Annex K functions: place of the capacity, and of the count or -1.
SECURE_FUNCTIONS = {
    "memcpy_s": (1, 3), "memmove_s": (1, 3), "memset_s": (1, 3), "strcpy_s": (1, -1), "strncpy_s": (1, 3),
    "strcat_s": (1, -1), "strncat_s": (1, 3), "sprintf_s": (1, -1), "snprintf_s": (1, 2), "vsprintf_s": (1, -1),
    "vsnprintf_s": (1, 2), "asctime_s": (1, -1), "ctime_s": (1, -1),
}
SCANF_S = {"scanf_s": 0, "sscanf_s": 1, "fscanf_s": 1}
ALLOCATORS = frozenset("malloc calloc realloc".split())
TAINT_SOURCES = frozenset("getenv gets getchar fgetc getcwd readlink".split())
#: Functions that fill a buffer: the first argument they fill; scanf's also fill those after it.
TAINT_FILLERS = {"fgets": 0, "gets": 0, "read": 1, "recv": 1, "recvfrom": 1, "recvmsg": 1, "scanf": 1, "vscanf": 1, "sscanf": 2, "fscanf": 2}
SCANF_FAMILY = frozenset("scanf sscanf fscanf vscanf".split())
#: Copies: the place of their source.
TAINT_COPIES = {
    "strcpy": 1, "strncpy": 1, "strcat": 1, "strncat": 1, "memcpy": 1, "memmove": 1,
    "strcpy_s": 2, "strncpy_s": 2, "strcat_s": 2, "strncat_s": 2, "memcpy_s": 2, "memmove_s": 2,
}
PASSTHROUGH = {"strdup": (0,), "_strdup": (0,), "strndup": (0,), "_strndup": (0,)}
NEVER_NULL_TYPES = frozenset({
    "size_t", "ssize_t", "int", "long", "short", "double", "float", "unsigned", "unsigned int", "unsigned long", "unsigned short",
    "unsigned long long", "long long", "int64_t", "uint64_t", "int32_t", "uint32_t", "int16_t", "uint16_t", "int8_t", "uint8_t", "bool", "_Bool",
})
NEVER_NULL_FUNCTIONS = frozenset("atoi atol atoll strtol strtoul strtoll strtoull strtod strtof strlen strcmp strncmp snprintf sprintf vsnprintf abs labs llabs".split())
OUTPUT_INITIALISERS = frozenset("""
pthread_create DES_set_key_unchecked DES_set_key_checked pthread_mutex_init pthread_cond_init pthread_rwlock_init
sem_init regcomp regexec OpenProcessToken GetTokenInformation RegCreateKeyExA RegCreateKeyExW RegOpenKeyExA RegOpenKeyExW
GetTempPathA GetTempPathW GetTempFileNameA GetTempFileNameW stat fstat lstat gettimeofday clock_gettime strtol strtoul
wcstombs memset bzero CreateProcessA CreateProcessW CreateProcessAsA CreateProcessAsW
""".split())
WEAK_CRYPTO = frozenset("""
DES_set_key_unchecked DES_set_key DES_ecb_encrypt DES_cbc_encrypt DES_ncbc_encrypt RC4_set_key
MD5 MD5_Init MD5_Update MD5_Final SHA1 SHA1_Init SHA1_Update SHA1_Final EVP_des_cbc EVP_des_ecb EVP_rc4 crypt
""".split())
WEAK_RANDOM = frozenset("rand srand".split())
RELEASES = frozenset("free fclose close pclose closedir fcloseall freopen".split())
LOCKS = frozenset("pthread_mutex_lock pthread_rwlock_wrlock EnterCriticalSection".split())
UNLOCKS = frozenset("pthread_mutex_unlock pthread_rwlock_unlock LeaveCriticalSection".split())
CHECK_FUNCTIONS = frozenset("access stat lstat faccessat".split())
USE_FUNCTIONS = frozenset("fopen open creat freopen openat".split())
UNCHECKED_APIS = frozenset("malloc calloc realloc fopen fdopen opendir read recv write send".split())
PATH_SINKS = frozenset("fopen open openat opendir unlink remove rename".split())
SIZE_FUNCTIONS = frozenset("malloc calloc realloc memcpy memmove memset mmap alloca strncpy strncat snprintf".split())
#: printf's family: the place of the format.
PRINTF_FORMAT = {
    "printf": 0, "vprintf": 0, "warn": 0, "warnx": 0, "fprintf": 1, "vfprintf": 1, "sprintf": 1, "vsprintf": 1,
    "syslog": 1, "err": 1, "errx": 1, "snprintf": 2, "vsnprintf": 2,
}
NULL_TEXTS = frozenset({"NULL", "nullptr", "(void*)0", "(void *)0", "((void*)0)", "((void *)0)"})
EXCLUDED_DIRS = ("deps", "third_party", "third-party", "vendor", "external", "node_modules", "tests", "test", "fuzzing", "contrib", "examples")
GUARD_BOUND, MIN_KEY_SIZE, WIDEN_AFTER = 32768, 16, 3
#: A call's result is tested by a condition at most so many lines below it.
GUARD_WITHIN = 2
BOUNDED_CATEGORIES = ("bounded_copy_overflow", "bounded_copy_var_size", "secure_copy_overflow", "secure_copy_var_size", "secure_constraint_violation", "secure_scanf_overflow", "secure_scanf_var_size")


def severity_of(api: str) -> int:
    if api in CRITICAL_APIS:
        return 100
    if api in HIGH_APIS:
        return 80
    if api in MEDIUM_APIS:
        return 60
    return 40 if api else 20
