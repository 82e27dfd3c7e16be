"""Recode tables of the clinical columns; fixed values."""

from __future__ import annotations

DIAGNOSTIC = {"BCC": 1, "SCC": 2, "ACK": 3, "SEK": 4, "NEV": 5, "MEL": 6}
GENDER = {"FEMALE": 0, "MALE": 1}
#: UNK is 2 in the table of metadata, 3 in that of fused features.
ANSWER = {"FALSE": 0, "TRUE": 1, "UNK": 2}
ANSWER_FUSED = {"FALSE": 0, "TRUE": 1, "UNK": 3}
COUNTRY = {
    "POMERANIA": 1, "GERMANY": 2, "NETHERLANDS": 3, "ITALY": 4, "POLAND": 5, "PORTUGAL": 6, "CZECH": 7, "NORWAY": 8, "SPAIN": 9, "AUSTRIA": 10,
    "FRANCE": 11, "BRAZIL": 12, "ISRAEL": 13,
}
REGION = {
    "FACE": 1, "SCALP": 2, "NOSE": 3, "EAR": 4, "LIP": 5, "NECK": 6, "CHEST": 7, "BACK": 8, "ABDOMEN": 9, "ARM": 10, "FOREARM": 11, "HAND": 12,
    "THIGH": 13, "FOOT": 14,
}
