"""Reading event payloads, raw logs and lookup tables; writing the domain."""
