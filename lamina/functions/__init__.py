"""Row generators and scalar expressions."""
