"""Danger rules for tool calls as column expressions: a call's text is brought to one form, cut into
the commands of its chain, and every command is held against the rules in order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scan import let
from ..functions.shell import canonical, chain, path_words

#: Reasons, in the wording of the audit log.
R_DENY, R_PIPE, R_PATH, R_SEND = "deny 名单精确匹配", "危险 shell: 网络拉取管道进解释器", "敏感路径写入", "网络外传"
#: Substrings that are dangerous wherever they stand, in order.
SUBSTRINGS = (
    (":(){:|:&};:", "fork 炸弹"), ("mkfs", "格式化文件系统"), ("of=/dev/", "裸设备写入"), (">/dev/sda", "裸设备写入"),
    ("chmod -r 777 /", "根目录权限破坏"), ("chmod 777 /", "根目录权限破坏"), ("rm -rf /", "根目录删除"), ("rm --no-preserve-root", "根目录删除"),
    ("nc -e", "反弹 shell"), ("netcat -e", "反弹 shell"), ("ncat -e", "反弹 shell"), ("/dev/tcp/", "bash 网络重定向"),
    ("sh -c", "shell 包装执行"), ("bash -c", "shell 包装执行"), ("eval ", "动态求值执行"), ("exec(", "动态求值执行"),
)
WORDS = (("shutdown", "系统关机"), ("reboot", "系统重启"), ("poweroff", "系统关机"), ("dd", "裸设备写入"))
SYSTEM_DIRS = ("/etc", "/usr", "/bin", "/sbin", "/var", "/boot", "/lib")
SENSITIVE = ("/etc/", "/etc/passwd", "/etc/shadow", "/root/", ".ssh/", "~/.ssh/", "/proc/", "/sys/", "/var/run/secrets/", "/boot/")
SHELL_TOOLS = ("exec", "run", "shell", "bash", "sh", "run_shell", "")
WRITE_TOOLS = ("edit", "write", "apply_patch", "save_file")
WRITE_WORDS = ("write_file", "patch", "echo", "cat", "tee", "cp", "mv", "edit", "write", "apply_patch", "save_file")

_BEFORE = r"(?:^|(?<=[\s;|&()\"'=$/]))"
_AFTER = r"(?=$|[\s;|&)\"'=])"


@dataclass(frozen=True)
class Policy:
    """Site rules beside the fixed ones; dangerous rules are (pattern, reason, network only)."""

    deny: tuple[str, ...] = ()
    block: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    internal: tuple[str, ...] = ()
    dangerous: tuple[tuple[str, str, bool], ...] = ()


def _word(command: Column, word: str, then: str = "") -> Column:
    return command.rlike(f"{_BEFORE}{word}{_AFTER}{then}")


def _after(command: Column, word: str) -> Column:
    """What follows the first such word; empty if there is none.  Later ones have less behind them."""
    return F.regexp_extract(command, f"(?s){_BEFORE}{word}{_AFTER}(.*)", 1)


def target_host(args: Column) -> Column:
    """Host of the first URL, or of the first bare target of a network command; empty if none."""
    url = F.regexp_extract(args, r"https?://([^/\s\"']+)", 1)
    bare = F.regexp_extract(args, r"(?:^|[^0-9A-Za-z])(?:curl|wget|nc|ncat|telnet)\s+(?:-\S++\s++)*+[\"']?([\w-]++(?:\.[\w-]++)++(?::\d+)?|localhost)", 1)
    return F.when(url != "", url).otherwise(bare)


def is_internal(host: Column, suffixes: tuple[str, ...]) -> Column:
    name = F.lower(F.regexp_replace(F.trim(host), r":\d+$|\.+$", ""))
    known = [name == "localhost", *[name.endswith(s.lower()) for s in (".local", ".internal", *suffixes) if s]]
    return (name != "") & reduce(lambda a, b: a | b, known)


def _piped(command: Column) -> Column:
    return command.rlike(r"\|sh|\| sh|\| ?bash|\| zsh|\| dash")


def _touches(command: Column, policy: Policy) -> Column:
    """Whether a path of the command begins with a sensitive one, once ``..`` is taken out."""
    paths = [p.lower() for p in (*SENSITIVE, *policy.paths) if p]
    low = F.lower(command)
    named = F.exists(path_words(command), lambda w: reduce(lambda a, b: a | b, [w.startswith(p) for p in paths]))
    marked = [low.contains(mark + p) for p in paths for mark in (">", "> ", '"', "'")]
    return named | reduce(lambda a, b: a | b, marked)


def _command_reason(segment: Column, policy: Policy, internal: Column) -> Column:
    return let(F.lower(segment), lambda low: _reason_of(segment, low, policy, internal))


def _reason_of(segment: Column, low: Column, policy: Policy, internal: Column) -> Column:
    shell = lambda text: F.lit(f"危险 shell: {text}")
    rules: list[tuple[Column, Column]] = [(low.contains(x), F.lit(f"命中自定义策略子串: {x}")) for x in policy.block if x]
    rules += [(low.contains(x), shell(why)) for x, why in SUBSTRINGS]
    rules += [(_word(low, w), shell(why)) for w, why in WORDS]
    dirs = "(?:" + "|".join(SYSTEM_DIRS) + ")"
    flags = F.regexp_extract_all(low, F.lit(rf"{_BEFORE}rm{_AFTER}((?:\s++-\S++)*+)"), F.lit(1))
    rules += [
        (F.exists(flags, lambda x: x.rlike(r"\s-\S*r") & x.rlike(r"\s-\S*f")), shell("rm -rf 递归强制删除")),
        (_after(low, "base64").rlike(r"\s(?:-d|--decode)(?=\s|$)"), shell("base64 解码")),
        (_after(low, "openssl").rlike(r"\s(?:-d|-decode|-decrypt|decode|decrypt)(?=\s|$)"), shell("openssl 解码")),
        (_word(low, "chmod", rf"(?:\s++-\S++)*+\s++\d{{3,4}}(?:\s++-\S++)*+\s++{dirs}"), shell("chmod 系统目录")),
        (_word(low, "chown", rf"(?:\s++-\S++)*+\s++[^\s-]\S*+(?:\s++-\S++)*+\s++{dirs}"), shell("chown 系统目录")),
        ((low.contains("curl") | low.contains("wget")) & _piped(low), F.lit(R_PIPE)),
        ((low.contains(">") | reduce(lambda a, b: a | b, [_word(low, w) for w in WRITE_WORDS])) & _touches(segment, policy), F.lit(R_PATH)),
    ]
    fetch = "|".join(("https?://", "ftp://", "-o ", "--output", ">", r"(?:^|\s)[\"']?[\w-]++(?:\.[\w-]++)++", "localhost"))
    send = (
        low.rlike(r"(?:scp|rsync|sftp|ftp) |/dev/tcp/") | reduce(lambda a, b: a | b, [_word(low, w) for w in ("telnet", "ssh", "nc", "ncat")])
        | (low.contains("curl") & low.rlike(r"--data| -d ")) | (low.contains("wget") & low.contains("--post-data")) | _after(low, "(?:curl|wget)").rlike(fetch)
    )
    rules.append((send & ~internal, F.lit(R_SEND)))
    return F.coalesce(*[F.when(hit, why) for hit, why in rules])


def danger_reason(tool: Column, args: Column, policy: Policy = Policy()) -> Column:
    """Why a call is dangerous, or null.  Linear in the length of the arguments."""
    given = F.coalesce(args, F.lit(""))
    named = F.coalesce(tool, F.lit(""))

    def judged(text: Column, internal: Column) -> Column:
        name, low = F.lower(named), F.lower(text)
        joined = F.when(name.isin(*SHELL_TOOLS), text).otherwise(F.concat_ws(" ", tool, text))
        reasons = F.filter(F.transform(chain(joined), lambda s: let(canonical(s), lambda c: _command_reason(c, policy, internal))), lambda r: r.isNotNull())
        extra = [
            F.when(F.lower(F.concat_ws(" ", tool, text)).contains(p.lower()) & (~internal if network else F.lit(True)), F.lit(why))
            for p, why, network in policy.dangerous if p
        ]
        return F.coalesce(
            F.when(tool.isin(*policy.deny), F.lit(R_DENY)) if policy.deny else F.lit(None).cast("string"),
            F.when((low.contains("curl") | low.contains("wget")) & _piped(low), F.lit(R_PIPE)),
            *extra,
            F.when(name.isin(*WRITE_TOOLS) & _touches(text, policy), F.lit(R_PATH)),
            F.get(reasons, 0),
        )

    inside = let(target_host(given), lambda host: is_internal(host, policy.internal))
    return let(F.struct(canonical(given).alias("text"), inside.alias("internal")), lambda x: judged(x["text"], x["internal"]))


def verdict(mode: str, reason: Column, approvers: tuple[str, ...] = ()) -> Column:
    """allow, block or need_approval; without approvers a call is blocked instead of waiting."""
    if mode == "off":
        return F.lit("allow")
    return F.when(reason.isNull(), "allow").otherwise("need_approval" if mode == "approve" and approvers else "block")
