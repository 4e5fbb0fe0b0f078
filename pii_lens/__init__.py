"""Finding, covering and auditing personal data as DataFrame operators."""
