"""Default rule sets, weights, policy and wording.

Everything below is a fixed value: results only agree with the audit-log
conventions this library follows if these lists, weights and phrases are kept
as they are.  Callers may pass their own dictionaries of the same shape.
"""

from __future__ import annotations

from pathlib import Path
from typing import Any

# --- fixed values: event flag rules -----------------------------------------
FLAG_RULES: dict[str, list[str]] = {
    "console_login_event_names": ["ConsoleLogin"],
    "auth_related_event_names": [
        "ConsoleLogin", "AssumeRole", "GetSessionToken", "GetFederationToken", "CreateLoginProfile",
        "UpdateLoginProfile", "ChangePassword", "CreateAccessKey", "DeleteAccessKey", "UpdateAccessKey",
        "AttachUserPolicy", "AttachRolePolicy", "PutUserPolicy", "PutRolePolicy", "AddUserToGroup",
        "CreateUser", "CreateRole", "PassRole",
    ],
    "s3_event_sources": ["s3.amazonaws.com"],
    "iam_event_sources": ["iam.amazonaws.com"],
    "ec2_event_sources": ["ec2.amazonaws.com"],
    "recon_event_names": [
        "DescribeInstances", "DescribeSecurityGroups", "DescribeVolumes", "DescribeSnapshots",
        "DescribeSubnets", "DescribeVpcs", "DescribeImages", "DescribeAddresses", "DescribeRegions",
        "DescribeAvailabilityZones", "ListBuckets", "GetBucketAcl", "GetBucketPolicy",
        "GetBucketLocation", "GetCallerIdentity",
    ],
    "privilege_change_event_names": [
        "AttachUserPolicy", "AttachRolePolicy", "PutUserPolicy", "PutRolePolicy", "AddUserToGroup",
        "CreateAccessKey", "UpdateAssumeRolePolicy", "PassRole", "PutBucketPolicy",
    ],
    "resource_creation_event_names": [
        "RunInstances", "CreateUser", "CreateRole", "CreatePolicy", "CreateBucket", "CreateFunction",
        "CreateKeyPair", "CreateSecurityGroup",
    ],
}

# --- fixed values: weak-label weights, thresholds, label cut ------------------
LABEL_RULES: dict[str, Any] = {
    "label_threshold": 5,
    "weights": {
        "recon_activity": 2,
        "privilege_change": 3,
        "resource_creation": 2,
        "console_login": 1,
        "root_actor": 2,
        "assumed_role_actor": 1,
        "high_failure_ratio": 2,
        "failure_burst": 2,
        "event_burst": 1,
        "broad_surface_area": 1,
        "iam_sequence": 1,
        "sts_sequence": 1,
        "ec2_sequence": 1,
        "recon_plus_privilege": 3,
        "recon_plus_resource_creation": 2,
        "privilege_plus_resource_creation": 2,
        "root_plus_privilege": 3,
    },
    "thresholds": {
        "high_failure_ratio": 0.5,
        "min_failure_events": 3,
        "high_event_count": 15,
        "high_distinct_event_names": 8,
        "short_incident_seconds": 900,
    },
}

# --- fixed values: rule name -> incident flag column, in report order ---------
RULE_COLUMNS: dict[str, str] = {
    "recon_activity": "contains_recon_like_api",
    "privilege_change": "contains_privilege_change_api",
    "resource_creation": "contains_resource_creation_api",
    "console_login": "contains_console_login",
    "root_actor": "actor_is_root",
    "assumed_role_actor": "actor_is_assumed_role",
    "high_failure_ratio": "has_high_failure_ratio",
    "failure_burst": "has_failure_burst",
    "event_burst": "has_event_burst",
    "broad_surface_area": "has_broad_surface_area",
    "iam_sequence": "has_iam_sequence",
    "sts_sequence": "has_sts_sequence",
    "ec2_sequence": "has_ec2_sequence",
    "recon_plus_privilege": "has_recon_plus_privilege",
    "recon_plus_resource_creation": "has_recon_plus_resource_creation",
    "privilege_plus_resource_creation": "has_privilege_plus_resource_creation",
    "root_plus_privilege": "has_root_plus_privilege",
}

SEQUENCE_SERVICES = {
    "has_iam_sequence": "iam.amazonaws.com",
    "has_sts_sequence": "sts.amazonaws.com",
    "has_ec2_sequence": "ec2.amazonaws.com",
}

# --- fixed values: response policy and action catalogue ------------------------
POLICY: dict[str, Any] = {
    "allowed_actions": [
        "reset_credentials", "temporary_access_lock", "continue_monitoring",
        "escalate_to_expert", "collect_more_evidence",
    ],
    "high_impact_actions": ["reset_credentials", "temporary_access_lock"],
    "default_non_expert_safe_action": "collect_more_evidence",
}

# label, priority, reversibility, disruption, needs approval, reason, tradeoff
_DISRUPTS = "This may disrupt legitimate access while evidence is still being reviewed."
ACTIONS: dict[str, dict[str, Any]] = {
    "reset_credentials": {
        "label": "Reset credentials", "priority": "high", "reversibility": "medium", "disruption": 3,
        "requires_human_approval": True,
        "reason": "Credential-focused containment is safer because the incident includes signals "
                  "consistent with elevated account misuse.",
        "tradeoff": _DISRUPTS,
    },
    "temporary_access_lock": {
        "label": "Temporarily lock access", "priority": "high", "reversibility": "high", "disruption": 3,
        "requires_human_approval": True,
        "reason": "Temporary containment is justified because the risk appears high and ongoing access "
                  "may increase impact.",
        "tradeoff": _DISRUPTS,
    },
    "continue_monitoring": {
        "label": "Continue monitoring", "priority": "low", "reversibility": "high", "disruption": 1,
        "requires_human_approval": False,
        "reason": "Current evidence supports continued review without immediate disruptive action.",
        "tradeoff": "This preserves business continuity but may leave some risk unresolved.",
    },
    "escalate_to_expert": {
        "label": "Escalate to expert", "priority": "medium", "reversibility": "high", "disruption": 1,
        "requires_human_approval": False,
        "reason": "The incident needs expert review because the risk or missing context may exceed "
                  "non-expert handling.",
        "tradeoff": "This adds a handoff step but reduces the chance of overreacting.",
    },
    "collect_more_evidence": {
        "label": "Collect more evidence", "priority": "medium", "reversibility": "high", "disruption": 1,
        "requires_human_approval": False,
        "reason": "Important checks or sources are still missing.",
        "tradeoff": "This may delay a stronger response if the incident is already active.",
    },
}

LEVELS = ["high", "medium", "low"]
CHECK_STATUSES = ["checked_signal_found", "checked_no_signal", "not_checked", "data_unavailable"]

# --- fixed values: coverage categories and their keywords ----------------------
COVERAGE_KEYWORDS: dict[str, list[str]] = {
    "login": ["login", "console", "signin", "auth"],
    "identity": ["identity", "iam", "role", "credential", "sts", "access_key", "user"],
    "network": ["network", "vpc", "flow", "ip", "dns", "traffic"],
    "resource_activity": ["resource", "ec2", "instance", "s3", "bucket", "lambda", "kms", "database"],
}

# --- fixed values: wording ------------------------------------------------------
SIGNAL_EXPLANATIONS: dict[str, str] = {
    "recon_activity": "The account explored the environment before taking further action.",
    "privilege_change": "Permissions or access levels changed during the incident.",
    "resource_creation": "New resources or infrastructure were created.",
    "console_login": "Someone signed in through the AWS console.",
    "root_actor": "The AWS root account was involved, which raises the impact of the activity.",
    "assumed_role_actor": "An assumed role was used, so the session may need extra tracing.",
    "high_failure_ratio": "A large share of the activity failed, which can indicate misuse or "
                          "trial-and-error behavior.",
    "failure_burst": "There was a burst of failed activity in a short time window.",
    "event_burst": "A high number of actions happened in a short window.",
    "broad_surface_area": "The activity touched many different actions or services.",
    "iam_sequence": "The sequence included identity and access management actions.",
    "sts_sequence": "The sequence included temporary credential or role-assumption activity.",
    "ec2_sequence": "The activity included EC2 infrastructure actions.",
    "recon_plus_privilege": "The actor first explored the environment, then changed permissions.",
    "recon_plus_resource_creation": "The actor first explored the environment, then created resources.",
    "privilege_plus_resource_creation": "Permissions changed and new resources were created in the same incident.",
    "root_plus_privilege": "The root account was used together with permission-changing activity.",
}

COVERAGE_STATUS_EXPLANATIONS: dict[str, str] = {
    "not_checked": "Some important checks were not completed yet.",
    "data_unavailable": "Some evidence could not be checked because the data was unavailable.",
    "unknown": "Some parts of the incident still need review before the picture is complete.",
}

PATTERN_QUERY_PHRASES: dict[str, str] = {
    "contains_recon_like_api": "reconnaissance burst",
    "contains_privilege_change_api": "privilege escalation attempt",
    "contains_resource_creation_api": "resource creation activity",
    "contains_console_login": "console login followed by sensitive actions",
    "has_high_failure_ratio": "failure dominated probing",
    "has_sts_sequence": "sts heavy session churn",
    "has_ec2_sequence": "high velocity ec2 activity",
    "actor_is_root": "root driven sensitive activity",
}

PATTERN_TITLES: dict[str, str] = {
    "has_recon_plus_privilege": "Reconnaissance followed by privilege change",
    "contains_console_login": "Suspicious console login",
    "contains_resource_creation_api": "Resource creation after sensitive activity",
}

REASON_SENTENCES: dict[str, str] = {
    "recon_plus_privilege": "Reconnaissance activity and privilege changes happened in the same incident.",
    "root_actor": "The root account was involved, which carries broader access and higher impact.",
    "contains_console_login": "An interactive console login was part of the activity.",
    "contains_privilege_change_api": "Permission or access-changing API calls were present.",
    "contains_recon_like_api": "The account was querying the environment in a way that looks like reconnaissance.",
}

FEATURE_SENTENCES: dict[str, str] = {
    "Failure ratio": "A higher failure ratio {} suspicion.",
    "Event count": "The number of events in this incident {} suspicion.",
    "Contains console login": "An interactive console login {} suspicion.",
    "Contains privilege change api": "Privilege-changing API calls {} suspicion.",
    "Contains recon like api": "Reconnaissance-style API calls {} suspicion.",
    "Has recon plus privilege": "The combination of reconnaissance and privilege changes {} suspicion.",
    "Actor is root": "Use of the root account {} suspicion.",
}

TIMELINE_PHRASES: dict[str, str] = {
    "consolelogin": "Signed in to the AWS console",
    "describeinstances": "Looked up existing virtual machines",
    "runinstances": "Launched a new virtual machine",
    "getcalleridentity": "Checked which account or role was active",
    "assumrole": "Switched into a temporary role",
    "creteaccesskey": "Created a new access key",
    "createaccesskey": "Created a new access key",
    "attachuserpolicy": "Attached a new permission policy to a user",
    "putuserpolicy": "Changed a user's permissions",
    "putrolepolicy": "Changed a role's permissions",
    "createuser": "Created a new user account",
    "createpolicy": "Created a new permission policy",
    "listbuckets": "Viewed the list of storage buckets",
    "getbucketpolicy": "Viewed a storage bucket policy",
    "describenetworkinterfaces": "Looked up network interface details",
    "startinstances": "Started an existing virtual machine",
    "stopinstances": "Stopped a virtual machine",
    "terminateinstances": "Terminated a virtual machine",
    "createinstanceprofile": "Created a new instance profile",
    "addroletoinstanceprofile": "Attached a role to an instance profile",
}

DISPLAY_LABELS: dict[str, str] = {
    "reset_credentials": "Reset credentials",
    "temporary_access_lock": "Temporarily lock access",
    "collect_more_evidence": "Collect more evidence",
    "escalate_to_expert": "Escalate to expert",
    "checked_signal_found": "Checked, signal found",
    "checked_no_signal": "Checked, no signal",
    "not_checked": "Not checked",
    "unavailable": "Could not check",
    "no_signal": "No signal found",
    "recon_activity": "Reconnaissance activity",
    "privilege_change": "Privilege change",
    "console_login": "Console login",
    "assumed_role_actor": "Assumed role actor",
    "iam_sequence": "IAM activity sequence",
    "sts_sequence": "STS activity sequence",
    "recon_plus_privilege": "Reconnaissance and privilege change pattern",
    "compromised_identity": "Compromised identity",
    "misconfigured_automation": "Misconfigured automation",
    "login": "Login",
    "identity": "Identity",
    "network": "Network",
}

# statement -> (signals, lower-cased event names); any member fires it
CONCERN_STATEMENTS: list[tuple[str, list[str], list[str]]] = [
    ("Someone signed in interactively through the AWS console", ["console_login"], ["consolelogin"]),
    ("the account then looked around existing cloud resources",
     ["recon_activity", "ec2_sequence"], ["describeinstances", "describenetworkinterfaces"]),
    ("new resources or access changes followed soon after",
     ["resource_creation", "recon_plus_resource_creation", "resource_creation_after_login"],
     ["runinstances", "createaccesskey", "createuser"]),
    ("permissions or access appear to have changed during the same sequence",
     ["privilege_change", "recon_plus_privilege"], []),
    ("the activity may still be ongoing", ["active_network_beaconing", "ongoing_session_activity"], []),
]

# --- fixed values: model feature lists --------------------------------------------
NUMERIC_FEATURES = [
    "incident_duration_seconds", "event_count", "distinct_event_names", "distinct_event_sources",
    "distinct_regions", "error_event_count", "success_event_count", "failure_ratio", "events_per_minute",
]
BOOLEAN_FEATURES = [
    "contains_console_login", "contains_recon_like_api", "contains_privilege_change_api",
    "contains_resource_creation_api", "actor_is_root", "actor_is_assumed_role", "has_high_failure_ratio",
    "has_failure_burst", "has_event_burst", "has_broad_surface_area", "has_iam_sequence", "has_sts_sequence",
    "has_ec2_sequence", "has_recon_plus_privilege", "has_recon_plus_resource_creation",
    "has_privilege_plus_resource_creation", "has_root_plus_privilege",
]
CATEGORICAL_FEATURES = [
    "actor_key", "primary_source_ip_address", "first_event_name", "last_event_name", "top_event_name",
]
# --- end of fixed values -------------------------------------------------------------


def _read_yaml(path: str | Path) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading rule files needs PyYAML; pass dictionaries instead") from exc
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_flag_rules(path: str | Path) -> dict[str, list[str]]:
    return {name: sorted({str(v) for v in values}) for name, values in _read_yaml(path).items()}


def load_label_rules(path: str | Path) -> dict[str, Any]:
    return {"weights": {}, "thresholds": {}, "label_threshold": 1, **_read_yaml(path)}


def load_policy(path: str | Path) -> dict[str, Any]:
    return check_policy(_read_yaml(path))


def check_policy(policy: dict[str, Any]) -> dict[str, Any]:
    """Reject an empty policy, an unknown action or a default outside the allowed set."""
    allowed = list(policy.get("allowed_actions") or [])
    if not allowed:
        raise ValueError("allowed_actions must not be empty")
    unknown = [a for a in allowed if a not in ACTIONS]
    if unknown:
        raise ValueError(f"unsupported actions: {', '.join(unknown)}")
    default = policy.get("default_non_expert_safe_action")
    if default and default not in allowed:
        raise ValueError("default_non_expert_safe_action must be an allowed action")
    return {**policy, "allowed_actions": allowed,
            "high_impact_actions": list(policy.get("high_impact_actions") or [])}
