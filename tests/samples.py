"""Small records in the public vendor shapes, and helpers to run them."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import functions as F

from sparkwarden.sources.catalog import SOURCES
from sparkwarden.sources.normalize import Scope, with_declared_scope

START = datetime(2031, 5, 4, 10, 0, 0, tzinfo=timezone.utc)
OBJECT_CLAIM = "http://schemas.microsoft.com/identity/claims/objectidentifier"
TENANT_CLAIM = "http://schemas.microsoft.com/identity/claims/tenantid"


def stamp(seconds: float = 0, nanos: int = 0) -> str:
    """RFC3339 text with nine digits, ``nanos`` added below the microsecond."""
    total = int(round(seconds * 1_000_000)) * 1000 + nanos
    whole, rest = divmod(total, 1_000_000_000)
    return (START + timedelta(seconds=whole)).strftime("%Y-%m-%dT%H:%M:%S") + f".{rest:09d}Z"


def trail(name, service="iam", at=0.0, **more):
    record = {
        "eventVersion": "1.1",
        "eventTime": stamp(at)[:26] + "Z" if at is not None else None,
        "eventSource": f"{service}.amazonaws.com",
        "eventName": name,
        "eventType": "AwsApiCall",
        "eventID": f"{name}-{at}",
        "recipientAccountId": "111",
        "userIdentity": {"principalId": "P1", "accessKeyId": "K0", "type": "IAMUser", "arn": "arn:p1"},
    }
    record.update(more)
    return {k: v for k, v in record.items() if v is not None}


def new_key(at=0.0, key="K1", **more):
    return trail("CreateAccessKey", at=at, **{"responseElements": {"accessKey": {"accessKeyId": key}}, **more})


def attach(at=60.0, key="K1", policy="AdministratorAccess", **more):
    fields = {
        "userIdentity": {"principalId": "P2", "accessKeyId": key},
        "requestParameters": {"userName": "target", "policyArn": f"arn:aws:iam::aws:policy/{policy}"},
    }
    return trail("AttachUserPolicy", at=at, **{**fields, **more})


def stop(at=0.0, name="main", **more):
    return trail("StopLogging", "cloudtrail", at, **{"requestParameters": {"name": name}, **more})


def restart(at=0.0, name="main", **more):
    return trail("StartLogging", "cloudtrail", at, **{"requestParameters": {"name": name}, **more})


def permission(protocol="tcp", low=22, high=22, v4=("0.0.0.0/0",), v6=()):
    return {
        "ipProtocol": protocol,
        "fromPort": low,
        "toPort": high,
        "ipRanges": {"items": [{"cidrIp": c} for c in v4]},
        "ipv6Ranges": {"items": [{"cidrIpv6": c} for c in v6]},
    }


def ingress(at=60.0, permissions=None, **more):
    request = {"groupId": "sg", "ipPermissions": {"items": permissions or [permission()]}}
    return trail("AuthorizeSecurityGroupIngress", "ec2", at, **{"requestParameters": request, **more})


def azure(operation, when, **more):
    record = {
        "eventDataId": f"{operation}-{when}",
        "eventTimestamp": when,
        "subscriptionId": "sub",
        "tenantId": "ten",
        "operationName": {"value": operation},
        "status": {"value": "Succeeded"},
        "claims": {OBJECT_CLAIM: "actor", TENANT_CLAIM: "home"},
    }
    record.update(more)
    return {k: v for k, v in record.items() if v is not None}


def diag_delete(when=None, **more):
    return azure("Microsoft.Insights/diagnosticSettings/delete", when or stamp(), **more)


def role_assign(when, **more):
    return azure("Microsoft.Authorization/roleAssignments/WRITE", when, **more)


def audit(activity, when, targets=("sp1",), **more):
    record = {
        "id": f"{activity}-{when}",
        "activityDateTime": when,
        "activityDisplayName": activity,
        "category": "ApplicationManagement",
        "result": "success",
        "initiatedBy": {"user": {"id": "admin"}},
        "targetResources": [{"id": t, "type": "ServicePrincipal"} for t in targets],
    }
    record.update(more)
    return record


def credential(when=None, **more):
    return audit("Add service principal credentials", when or stamp(), **more)


def app_role(when, **more):
    return audit("Add app role assignment to service principal", when, **more)


KEY = "projects/p/serviceAccounts/s/keys/k"


def gcp(method, when, service="iam", payload=None, **more):
    return {
        "logName": "projects/p/logs/activity",
        "insertId": f"{method}-{when}",
        "timestamp": when,
        **more,
        "protoPayload": {
            "@type": "type.googleapis.com/google.cloud.audit.AuditLog",
            "serviceName": f"{service}.googleapis.com",
            "methodName": method,
            "status": {},
            **(payload or {}),
        },
    }


def gcp_new_key(when=None, name=KEY, **more):
    return gcp(
        "google.iam.admin.v1.CreateServiceAccountKey", when or stamp(),
        payload={"response": {"name": name}, **more},
    )


def set_policy(when, key=KEY, **more):
    info = {"authenticationInfo": {"serviceAccountKeyName": f"//iam.googleapis.com/{key}"}}
    return gcp("SetIamPolicy", when, "cloudresourcemanager", {**info, **more})


def bucket_policy(deltas, **more):
    data = {
        "@type": "type.googleapis.com/google.iam.v1.logging.AuditData",
        "policyDelta": {"bindingDeltas": deltas},
    }
    return gcp(
        "storage.setIamPermissions", stamp(), "storage",
        {"resourceName": "bucket", "serviceData": data, **more}, resource={"type": "gcs_bucket"},
    )


def normalize(spark, source, records, scope=None):
    """Normalised rows of records given as Python objects or JSON text."""
    texts = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    frame = spark.createDataFrame(texts, "row int, text string").withColumn(
        "record", F.parse_json("text")
    )
    if scope is None and source.startswith("azure.entra"):
        scope = Scope("azure.tenant", "t1", "t1")
    job = next(j for j in SOURCES if j.source == source)
    return job.normalize(with_declared_scope(frame.drop("text"), scope))


def events(spark, source, records, scope=None):
    return normalize(spark, source, records, scope).where(F.size("problems") == 0)


def write_dataset(folder: Path, source, files, fmt, provider, dataset_id="d1", formats=None, **more) -> str:
    """Files (name -> text) and their manifest; returns the manifest path. ``formats``
    names the format of single files."""
    folder.mkdir(parents=True, exist_ok=True)
    listed = []
    for name, text in files.items():
        (folder / name).write_text(text)
        digest = hashlib.sha256(text.encode()).hexdigest()
        listed.append({"path": name, "sha256": digest, "format": (formats or {}).get(name, fmt)})
    manifest = {
        "dataset_id": dataset_id,
        "provider": provider,
        "source": source,
        "category": "synthetic",
        "source_urls": ["https://example.org/logs"],
        "license": "test",
        "modified": False,
        "limitations": [],
        "files": listed,
        **more,
    }
    path = folder / "manifest.json"
    path.write_text(json.dumps(manifest))
    return str(path)
