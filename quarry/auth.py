"""Who may do what: an append-only ledger of grants and revocations.

A line of the file is an event, and what is known is what the events add up to; nothing is ever rewritten. A token that
the ledger issues begins with a handle, so that one derivation decides about it and not one for each holder. A last line
that was torn while it was written never happened."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import secrets
from collections.abc import Iterator
from typing import Any, NamedTuple

from quarry.errors import IdentityError

#: Rounds of the derivation, the roles from the least to the greatest, and the least role that may do a thing.
ROUNDS = 310_000
ROLES = ("reader", "operator", "admin")
LEAST_ROLE = {"read": "reader", "memory_read": "reader", "prompt_preview": "reader", "write": "operator", "memory_write": "operator", "prompt_approve": "operator", "audit": "operator", "identity_admin": "admin"}
LEAST_TOKEN, LONGEST_NAME = 16, 120
HEAD = {"ledger": "quarry-grants", "version": 1, "rounds": ROUNDS}


class Holder(NamedTuple):
    username: str
    role: str


class _Grant(NamedTuple):
    holder: Holder
    salt: bytes
    proof: bytes

    def fits(self, token: str) -> bool:
        return hmac.compare_digest(_proof(token, self.salt), self.proof)


def _proof(token: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", token.encode(), salt, ROUNDS)


class IdentityStore:
    """Holders of tokens. Without a path they last as long as this object. The file is its owner's alone, and no token is in it."""

    def __init__(self, path: str | None = None):
        self.path, self.whole = path, 0
        self.names: set[str] = set()
        self.by_handle: dict[str, _Grant] = {}
        for event in self._told():
            self._take(event)

    def _told(self) -> Iterator[dict[str, Any]]:
        """The events of the file, up to the end of its last whole line."""
        if not self.path or not os.path.exists(self.path):
            return
        with open(self.path, "rb") as f:
            text = f.read()
        self.whole = text.rfind(b"\n") + 1
        try:
            head, *events = (json.loads(line) for line in text[: self.whole].splitlines() or [text])
        except ValueError as e:
            raise IdentityError("the ledger cannot be read") from e
        if head != HEAD:
            raise IdentityError("not a ledger of this kind")
        yield from events

    def _take(self, event: dict[str, Any]) -> None:
        """Adds an event to what is known."""
        match event:
            case {"grant": str(handle), "to": str(name), "role": str(role), "salt": str(salt), "proof": str(proof)} if role in ROLES and len(salt) == 32 and len(proof) == 64:
                self.names.add(name)
                self.by_handle[handle] = _Grant(Holder(name, role), bytes.fromhex(salt), bytes.fromhex(proof))
            case {"revoke": str(name)}:
                self.by_handle = {h: g for h, g in self.by_handle.items() if g.holder.username != name}
            case _:
                raise IdentityError("the ledger has an event that is none")

    def _happen(self, event: dict[str, Any]) -> None:
        """Makes an event durable, then known."""
        if self.path:
            line = b"".join(json.dumps(x, sort_keys=True).encode() + b"\n" for x in ([event] if self.whole else [HEAD, event]))
            os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
            file = os.open(self.path, os.O_RDWR | os.O_CREAT, 0o600)
            try:
                os.ftruncate(file, self.whole)  # a torn line goes
                os.pwrite(file, line, self.whole)
                os.fsync(file)
            finally:
                os.close(file)
            self.whole += len(line)
        self._take(event)

    def _grant(self, handle: str, username: Any, token: Any, role: str) -> Holder:
        name = username.strip() if isinstance(username, str) else ""
        wrong = {
            f"a name has 1 to {LONGEST_NAME} characters": not 0 < len(name) <= LONGEST_NAME,
            f"a token has {LEAST_TOKEN} characters or more": not isinstance(token, str) or len(token) < LEAST_TOKEN,
            f"there is no role {role}": role not in ROLES,
            f"{name} has been granted a role before": name in self.names,
        }
        for message in (m for m, holds in wrong.items() if holds):
            raise IdentityError(message)
        salt = secrets.token_bytes(16)
        self._happen({"grant": handle, "to": name, "role": role, "salt": salt.hex(), "proof": _proof(token, salt).hex()})
        return self.by_handle[handle].holder

    def add(self, username: str, token: str, role: str = "operator") -> Holder:
        """Grants a role to whoever has a token of the caller's own. Such a token has no handle: it is tried against all of its kind."""
        return self._grant(f"+{secrets.token_hex(8)}", username, token, role)

    def issue(self, username: str, role: str = "operator") -> tuple[Holder, str]:
        handle = secrets.token_hex(8)
        token = f"{handle}.{secrets.token_urlsafe(32)}"
        return self._grant(handle, username, token, role), token

    def revoke(self, username: str) -> None:
        """Ends what was granted to a name, for good."""
        if username not in self.names:
            raise IdentityError(f"{username} is not in the ledger")
        self._happen({"revoke": username})

    def authenticate(self, token: str | None) -> Holder | None:
        if not isinstance(token, str) or len(token) < LEAST_TOKEN:
            return None
        own = self.by_handle.get(token.partition(".")[0])
        asked = [own] if own else [g for h, g in self.by_handle.items() if h.startswith("+")]
        return next((g.holder for g in asked if g.fits(token)), None)

    @staticmethod
    def allowed(holder: Holder, permission: str) -> bool:
        return permission in LEAST_ROLE and ROLES.index(holder.role) >= ROLES.index(LEAST_ROLE[permission])
