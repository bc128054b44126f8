"""python -m citeloom METHOD [--jsonl] FILE...: a method over files; batch reads one request a line."""

from __future__ import annotations

import json
import sys

from . import api


def main(args: list[str]) -> int:
    if not args or args[0].startswith("-"):
        print(__doc__, file=sys.stderr)
        return 2
    method, rest = args[0], [a for a in args[1:] if a != "--jsonl"]
    try:
        for name in rest or ["-"]:
            body = sys.stdin.read() if name == "-" else open(name, encoding="utf-8").read()
            if method == "batch":
                for line in filter(str.strip, body.splitlines()):
                    r = {}
                    try:
                        r = json.loads(line)
                        print(json.dumps({"id": r.get("id"), "result": api.call(r["method"], r.get("request"))}, ensure_ascii=False))
                    except (ValueError, KeyError, TypeError) as e:
                        print(json.dumps({"id": r.get("id") if isinstance(r, dict) else None, "error": {"message": str(e)}}, ensure_ascii=False))
            elif "--jsonl" in args:
                for i, line in enumerate(body.splitlines(), 1):
                    if line.strip():
                        x = json.loads(line)
                        text = x if isinstance(x, str) else x["text"]
                        print(json.dumps({"file": name, "line": i, "result": api.call(method, {"text": text})}, ensure_ascii=False))
            else:
                print(json.dumps(api.call(method, {"text": body}), ensure_ascii=False))
    except OSError as e:
        print(e, file=sys.stderr)
        return 1
    except ValueError as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
