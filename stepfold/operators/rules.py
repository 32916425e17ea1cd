"""Rule constants: fixed values that reports and verdicts share, and the switches that turn a check off."""

from __future__ import annotations

# The rule ids and the phrases under which a specification is searched for each.
SPEC_QUERIES = {
    "OBSERVE_ERROR": "status code error response",
    "STARTSESSION_EFFECT": "StartSession HostSessionID SPSessionID HostChallenge",
    "ENDSESSION_EFFECT": "EndSession session close",
    "SET_CPIN_SECRET": "C_PIN Set PIN credential",
    "ACTIVATE_SP_EFFECT": "Activate SP",
    "WRITE_PAYLOAD_EFFECT": "Data Write LBA payload",
    "GENKEY_EFFECT": "GenKey media encryption key",
    "PARSE_FINAL_COMMAND": "method command status parsing",
    "PROPERTIES_TARGET": "Properties Session Manager UID target",
    "PROPERTIES_PAYLOAD": "Properties MaxMethods MaxSessions MaxPacketSize",
    "STARTSESSION_FINAL": "StartSession HostChallenge HostSigningAuthority",
    "PRECONDITION_EXPECTED_ERROR": "method precondition NOT_AUTHORIZED INVALID_PARAMETER",
    "UNEXPECTED_ERROR_STATUS": "method status code SUCCESS FAIL NOT_AUTHORIZED",
    "KNOWN_FIELD_INVALID_VALUE": "Object table field boolean value INVALID_PARAMETER",
    "KNOWN_FIELD_EXPECTED_SUCCESS": "Object table Get Set field access expected SUCCESS",
    "ACTIVATE_TARGET": "Activate SP UID",
    "ACTIVATE_PAYLOAD": "Activate SP empty result list",
    "ENDSESSION_PAYLOAD": "EndSession close session empty result list",
    "SET_PAYLOAD": "Set method empty result list RowValues duplicate column INVALID_PARAMETER",
    "READ_PAYLOAD": "Read LBA result GenKey",
    "WRITE_RESPONSE": "Write DATA_COMMAND response command payload",
    "LOCKING_DATA_ACCESS": "ReadLocked WriteLocked ReadLockEnabled WriteLockEnabled user data",
    "SET_OBJECT_FIELDS": "Set Values table column object",
    "GET_PAYLOAD": "Get Cellblock startColumn endColumn return_values",
    "GENKEY_PAYLOAD": "GenKey empty return_values response",
    "AUTHENTICATE_NO_SESSION": "Authenticate method session required",
    "AUTHENTICATE_SUCCESS": "Authenticate method result True False",
    "DEFAULT_PASS": "method response status compliance",
}

# The columns of each kind of object that may be read and written, and those that are boolean.
ACCESSIBLE_COLUMNS = {"cpin": ["3"], "authority": ["5"], "locking": ["3", "4", "5", "6", "7", "8"], "mbrcontrol": ["1", "2"]}
BOOLEAN_COLUMNS = {"authority": ["5"], "locking": ["5", "6", "7", "8"], "mbrcontrol": ["1", "2"]}
#: Tried in this order: by name, then by the start of the UID.
KIND_UIDS = {"mbrcontrol": "00000803", "locking": "00000802", "authority": "00000009", "cpin": "0000000b"}

SESSION_METHODS = ["get", "set", "activate", "genkey", "read", "write", "endsession"]
AUTHENTICATED_METHODS = ["set", "activate", "genkey", "write"]

#: What each mutant of the rules switches off; see `cascade.judge`. The last two are baselines.
MUTANTS = {
    "NO_STARTSESSION_FINAL": "startsession", "NO_KNOWN_FIELD_EXPECTED_SUCCESS": "known_field_success", "NO_GET_PAYLOAD": "get_payload",
    "NO_READ_PAYLOAD": "read_payload", "NO_PRECONDITION_ERROR": "precondition", "NO_PROPERTIES_PAYLOAD": "properties_payload",
    "NO_EMPTY_RESULT": "empty_result", "NO_LOCKING_DATA_ACCESS": "locking", "NO_ACTIVATE_TARGET": "activate_target",
    "NO_PROPERTIES_TARGET": "properties_target", "NO_DISABLED_AUTHORITY": "disabled_authority", "ALWAYS_PASS": "always_pass", "ALWAYS_FAIL": "always_fail",
}
BASELINES = ["ALWAYS_PASS", "ALWAYS_FAIL"]
