"""The rule pack: 55 rules of 13 categories, in the order in which they are tried."""

from __future__ import annotations

from functools import lru_cache

from vigilake.rules.loader import load
from vigilake.rules.model import Evaluator

BOTH, BEFORE = ["tool.before", "tool.after"], ["tool.before"]
EXEC = {"tool_name": "exec"}
READ_OR_EXEC = {"tool_name": ["read_file", "exec"]}
COMMAND, PATH = "tool_args.command|contains", "tool_args.path|contains"


def _regex(id_: str, title: str, pattern: str, action: str, **more) -> dict:
    return {"id": id_, "title": title, "pattern": pattern, "action": action, **more}


def _on_command(id_: str, title: str, pattern: str, action: str) -> dict:
    return _regex(id_, title, pattern, action, fields=["tool_args.command"])


def _words(id_: str, title: str, action: str, *keywords: str) -> dict:
    return {"id": id_, "title": title, "keywords": list(keywords), "action": action}


def _sigma(category: str, id_: str, title: str, condition: str, **selections) -> dict:
    return {"category": category, "id": id_, "title": title, "detection": {**selections, "condition": condition}, "action": "block"}


def _cel(id_: str, title: str, expr: str, action: str, reason: str) -> dict:
    return {"id": id_, "title": title, "expr": expr, "action": action, "reason": reason}


# Fixed values from here on: identifiers, titles, patterns, words, actions and reasons that decisions must agree in.
EVALUATORS = [
    {
        "name": "secrets-scanner",
        "type": "regex",
        "stages": BOTH,
        "rules": [
            _regex("regex-sec-001", "AWS Access Key", r"AKIA[0-9A-Z]{16}", "redact"),
            _regex("regex-sec-002", "AWS Secret Key", r"(?i)aws_secret_access_key\s*[=:]\s*[A-Za-z0-9/+=]{40}", "redact"),
            _regex("regex-sec-003", "GitHub Personal Access Token", r"ghp_[A-Za-z0-9]{36}", "redact"),
            _regex("regex-sec-004", "GitHub Fine-Grained Token", r"github_pat_[A-Za-z0-9_]{82}", "redact"),
            _regex("regex-sec-005", "Generic API Key", r"(?i)(api[_-]?key|apikey|secret[_-]?key)\s*[=:]\s*['\"]?[A-Za-z0-9]{20,}", "redact"),
            _regex("regex-sec-006", "Private Key Block", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "block"),
        ],
    },
    {
        "name": "pii-scanner",
        "type": "regex",
        "stages": ["tool.after"],
        "rules": [
            _regex("regex-pii-001", "Social Security Number", r"\b\d{3}-\d{2}-\d{4}\b", "redact"),
            _regex("regex-pii-002", "Credit Card - Visa", r"\b4\d{3}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "redact"),
            _regex("regex-pii-003", "Credit Card - Mastercard", r"\b5[1-5]\d{2}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "redact"),
            _regex("regex-pii-004", "Credit Card - Amex", r"\b3[47]\d{2}[- ]?\d{6}[- ]?\d{5}\b", "redact"),
            _regex("regex-pii-005", "US Phone Number", r"\b(?:\+1[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b", "redact"),
        ],
    },
    {
        "name": "data-exfiltration",
        "type": "regex",
        "stages": BOTH,
        "rules": [
            _regex("regex-exfil-001", "Base64-encoded secret indicator", r"(?i)(password|secret|token|key)[=:]\s*[A-Za-z0-9+/]{40,}={0,2}", "detect"),
            _regex("regex-exfil-002", "Long hex-encoded data block", r"\b[0-9a-fA-F]{64,}\b", "detect"),
            _regex("regex-exfil-003", "Data URI with base64", r"data:[a-z/]+;base64,[A-Za-z0-9+/]{100,}", "detect"),
        ],
    },
    {
        "name": "dangerous-commands",
        "type": "regex",
        "stages": BEFORE,
        "rules": [
            _on_command("regex-cmd-001", "Recursive delete root", r"rm\s+-[a-zA-Z]*r[a-zA-Z]*f[a-zA-Z]*\s+/", "block"),
            _on_command("regex-cmd-002", "Format disk", r"mkfs\.", "block"),
            _on_command("regex-cmd-003", "Disk overwrite", r"dd\s+.*of=/dev/", "block"),
            _on_command("regex-cmd-004", "Chmod 777 recursive", r"chmod\s+-[a-zA-Z]*R[a-zA-Z]*\s+777", "detect"),
            _on_command("regex-cmd-005", "Curl pipe to shell", r"curl\s+.*\|\s*(bash|sh|zsh)", "block"),
        ],
    },
    {
        "name": "sql-keywords",
        "type": "pattern",
        "stages": ["message.before", "tool.before"],
        "rules": [_words("pat-sql-001", "SQL destructive keywords", "detect", "DROP TABLE", "DROP DATABASE", "DELETE FROM", "TRUNCATE TABLE", "'; --", "1=1")],
    },
    {
        "name": "supply-chain",
        "type": "pattern",
        "stages": BEFORE,
        "rules": [
            _words("pat-sc-001", "Pip install from custom index", "block", "pip install --index-url", "pip install --extra-index-url", "pip install -i http"),
            _words("pat-sc-002", "Npm install from custom registry", "block", "npm install --registry", "npm config set registry", "yarn config set registry"),
            _words("pat-sc-003", "Wget pipe to shell", "block", "wget -O - | bash", "wget -O - | sh", "wget -q -O - | bash"),
            _words("pat-sc-004", "Gem install from custom source", "block", "gem install --source http", "gem sources --add http"),
        ],
    },
    {
        "name": "sigma-threats",
        "type": "sigma",
        "stages": ["message.before", "tool.before", "tool.after"],
        "rules": [
            _sigma("dangerous-tools", "dt-001", "Suspicious file write outside workspace", "selection and (target_paths or home_ssh)", selection={"tool_name": "write_file"}, target_paths={"tool_args.path|startswith": ["/etc/", "/usr/", "/var/", "/root/"]}, home_ssh={PATH: ".ssh/"}),
            _sigma("dangerous-tools", "dt-002", "Shell command with network exfiltration indicators", "selection and network_tools and data_pipes", selection=EXEC, network_tools={COMMAND: ["curl", "wget", "nc ", "ncat", "netcat"]}, data_pipes={COMMAND: ["|", ">", "base64"]}),
            _sigma("dangerous-tools", "dt-003", "Database credential access via tool", "selection and (sensitive_paths or sensitive_commands)", selection=READ_OR_EXEC, sensitive_paths={PATH: [".env", "credentials", "database.yml", "secrets.yaml", "wp-config.php"]}, sensitive_commands={COMMAND: ["cat .env", "cat credentials", "printenv"]}),
            _sigma("prompt-injection", "pi-001", "System prompt extraction attempt", "extract_direct or extract_repeat", extract_direct={"message_text|contains": ["ignore previous instructions", "ignore all previous", "disregard previous", "disregard your instructions", "forget your instructions", "override your instructions"]}, extract_repeat={"message_text|contains": ["repeat the above", "repeat your instructions", "print your system prompt", "show your system prompt", "what is your system prompt", "output your initial prompt", "display your instructions"]}),
            _sigma("prompt-injection", "pi-002", "Jailbreak pattern detected", "jailbreak_identity or jailbreak_mode", jailbreak_identity={"message_text|contains": ["you are now", "from now on you are", "pretend you are", "act as an unrestricted", "simulate being"]}, jailbreak_mode={"message_text|contains": ["DAN mode", "developer mode", "jailbreak mode", "unrestricted mode", "no restrictions", "without any ethical", "without safety"]}),
            _sigma("prompt-injection", "pi-003", "Role-play escape attempt", "roleplay", roleplay={"message_text|contains": ["roleplay as", "role-play as", "assume the role of", "you have no restrictions", "you can do anything", "act as if you have no guardrails", "bypass your safety", "ignore your safety"]}),
            _sigma("recon", "recon-001", "Sensitive file read - credentials and keys", "selection and (ssh_keys or credential_files or aws_credentials or gcp_credentials)", selection=READ_OR_EXEC, ssh_keys={PATH: [".ssh/id_", ".ssh/authorized_keys", ".ssh/known_hosts", ".ssh/config"]}, credential_files={"tool_args.path|endswith": [".pem", ".key", ".p12", ".pfx", ".keystore"]}, aws_credentials={PATH: [".aws/credentials", ".aws/config"]}, gcp_credentials={PATH: ["service-account", "application_default_credentials"]}),
            _sigma("recon", "recon-002", "System file reconnaissance", "selection and (system_files or commands)", selection=READ_OR_EXEC, system_files={PATH: ["/etc/passwd", "/etc/shadow", "/etc/hosts", "/etc/group", "/proc/self/"]}, commands={COMMAND: ["cat /etc/passwd", "cat /etc/shadow", "/proc/self/environ"]}),
            _sigma("recon", "recon-003", "Cloud metadata endpoint access", "selection and metadata_endpoints", selection=EXEC, metadata_endpoints={COMMAND: ["169.254.169.254", "metadata.google.internal", "metadata.azure.com"]}),
            _sigma("recon", "recon-004", "Container and orchestration config access", "selection and (kube_config or docker_config)", selection=READ_OR_EXEC, kube_config={PATH: [".kube/config", "kubeconfig"]}, docker_config={PATH: [".docker/config.json", "/var/run/docker.sock"]}),
            _sigma("shadow-it", "shadow-001", "Container runtime operations", "selection and container_ops", selection=EXEC, container_ops={COMMAND: ["docker run", "docker build", "docker exec", "docker compose up", "docker-compose up", "podman run", "podman build"]}),
            _sigma("shadow-it", "shadow-002", "Kubernetes cluster operations", "selection and k8s_ops", selection=EXEC, k8s_ops={COMMAND: ["kubectl apply", "kubectl create", "kubectl delete", "kubectl patch", "kubectl scale", "helm install", "helm upgrade"]}),
            _sigma("shadow-it", "shadow-003", "Cloud infrastructure provisioning", "selection and (terraform or cloud_cli)", selection=EXEC, terraform={COMMAND: ["terraform apply", "terraform destroy", "pulumi up", "pulumi destroy"]}, cloud_cli={"tool_args.command|re": [r"^aws\s", r"^gcloud\s", r"^az\s"]}),
            _sigma("shadow-it", "shadow-004", "User account management", "selection and user_mgmt", selection=EXEC, user_mgmt={COMMAND: ["useradd", "adduser", "usermod", "groupadd", "passwd "]}),
        ],
    },
    {
        "name": "cel-policies",
        "type": "cel",
        "stages": BEFORE,
        "rules": [
            _cel("cel-pol-001", "Block recursive file deletion", r'tool_name == "exec" && tool_args_command.matches("rm\\s+-r")', "block", "Recursive file deletion is not allowed"),
            _cel("cel-pol-002", "Block world-writable permissions", r'tool_name == "exec" && tool_args_command.contains("chmod 777")', "block", "Setting world-writable permissions is not allowed"),
            _cel("cel-pol-003", "Detect sudo usage", r'tool_name == "exec" && tool_args_command.startsWith("sudo")', "detect", "Elevated privilege execution detected"),
            _cel("cel-pol-004", "Detect environment variable dump", r'tool_name == "exec" && (tool_args_command == "env" || tool_args_command == "printenv" || tool_args_command.contains("export"))', "detect", "Environment variable dump may expose secrets"),
        ],
    },
    {
        "name": "cel-privilege-escalation",
        "type": "cel",
        "stages": BEFORE,
        "rules": [
            _cel("cel-pe-001", "Block sudo privilege escalation", r'tool_name == "exec" && tool_args_command.matches("^sudo\\s")', "block", "Privilege escalation via sudo is not allowed"),
            _cel("cel-pe-002", "Block user switching", r'tool_name == "exec" && tool_args_command.matches("^su\\s+-|^su\\s+root")', "block", "Switching to another user is not allowed"),
            _cel("cel-pe-003", "Block pkexec privilege escalation", r'tool_name == "exec" && tool_args_command.contains("pkexec")', "block", "Privilege escalation via pkexec is not allowed"),
            _cel("cel-pe-004", "Block doas privilege escalation", r'tool_name == "exec" && tool_args_command.matches("^doas\\s")', "block", "Privilege escalation via doas is not allowed"),
            _cel("cel-pe-005", "Block chown to root", r'tool_name == "exec" && tool_args_command.matches("chown\\s+root")', "block", "Changing file ownership to root is not allowed"),
            _cel("cel-pe-006", "Block setuid bit", r'tool_name == "exec" && tool_args_command.contains("chmod u+s")', "block", "Setting setuid bit is not allowed"),
            _cel("cel-pe-007", "Block sudoers modification", r'tool_name == "exec" && (tool_args_command.contains("visudo") || tool_args_command.contains("/etc/sudoers"))', "block", "Modifying sudoers configuration is not allowed"),
        ],
    },
    {
        "name": "cel-model-manipulation",
        "type": "cel",
        "stages": BEFORE,
        "rules": [
            _cel("cel-mm-001", "Block system prompt injection via tools", r'tool_args_command.contains("system_prompt") || tool_args_command.contains("system_message")', "block", "Modifying system prompt via tool calls is not allowed"),
            _cel("cel-mm-002", "Detect temperature override attempt", r'tool_args_command.contains("temperature") && tool_args_command.matches("temperature.*(=|:)\\s*[0-9]")', "detect", "Attempt to modify model temperature parameter detected"),
            _cel("cel-mm-003", "Detect tool definitions tampering", r'tool_args_command.contains("tool_definitions") || tool_args_command.contains("\"tools\"")', "detect", "Attempt to modify tool definitions detected"),
            _cel("cel-mm-004", "Detect max_tokens override attempt", r'tool_args_command.contains("max_tokens") && tool_args_command.matches("max_tokens.*(=|:)\\s*[0-9]")', "detect", "Attempt to modify max_tokens parameter detected"),
        ],
    },
    {
        "name": "rate-limits",
        "type": "sql",
        "stages": BOTH,
        "rules": [
            {"id": "sql-rl-001", "title": "High tool call rate", "rate": {"keys": ("session_id",), "window": 60, "condition": "cnt > 50"}, "action": "detect", "reason": "Unusually high tool call rate (>50/min)"},
            {"id": "sql-rl-002", "title": "Repeated tool abuse", "rate": {"keys": ("session_id", "tool_name"), "window": 300, "condition": "cnt > 20"}, "action": "detect", "reason": "Same tool called >20 times in 5 minutes"},
        ],
    },
]
# Category -> evaluators, and the categories of their rules that belong to it (all if none are named).
CATEGORIES = {
    "secrets": ("secrets-scanner", None),
    "pii": ("pii-scanner", None),
    "exfiltration": ("data-exfiltration", None),
    "dangerous_commands": ("dangerous-commands cel-policies", None),
    "sql_keywords": ("sql-keywords", None),
    "supply_chain": ("supply-chain", None),
    "prompt_injection": ("sigma-threats", "prompt-injection"),
    "dangerous_tools": ("sigma-threats", "dangerous-tools"),
    "recon": ("sigma-threats", "recon"),
    "shadow_it": ("sigma-threats", "shadow-it"),
    "privilege_escalation": ("cel-privilege-escalation", None),
    "model_manipulation": ("cel-model-manipulation", None),
    "resource_abuse": ("rate-limits", None),
}


@lru_cache(maxsize=1)
def rule_pack() -> tuple[Evaluator, ...]:
    return tuple(load({"evaluators": EVALUATORS}))


def category(name: str) -> list[Evaluator]:
    """The evaluators of one category, with its rules only."""
    names, only = CATEGORIES[name]
    out = []
    for e in rule_pack():
        if e.name in names.split():
            out.append(Evaluator(e.name, e.type, e.stages, tuple(r for r in e.rules if only is None or r.category == only)))
    return out
